"""All layout queries, and their DuckDB SQL, by name."""

from pagelattice.plans import alignment, details, documents, folds, geometry, layout, lines, pages, styles, tables

MODULES = (geometry, lines, pages, alignment, tables, layout, styles, documents, details)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()} | folds.SQL
