"""pagelattice: document-layout analytics over DataFrames keyed by document and page."""
