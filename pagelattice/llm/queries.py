"""Queries of this subpackage, by name: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from pagelattice.llm import bpe, chat, collocations, ctw, fingerprints, mixing, neardup, spelling, substring, tiff, toxicity, vectors, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_tiff": tiff.op2_tiff,
    "op3_neardup": neardup.op3_neardup,
    "op4_ctw": ctw.op4_ctw,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring": substring.op6_substring,
    "op7_bpe": bpe.op7_bpe,
    "op8_chat": chat.op8_chat,
    "op9_warc": warc.op9_warc,
    "op10_vectors": vectors.op10_vectors,
    "op11_spelling": spelling.op11_spelling,
    "op12_collocations": collocations.op12_collocations,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

SQL = {"op1_mix": mixing.OP1_SQL, "op11_spelling": spelling.OP11_SQL, "op12_collocations": collocations.OP12_SQL}
