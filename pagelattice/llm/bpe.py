"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelattice.llm.common import map_arrow

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Longer texts are cut before encoding, so that no call sees more than about this many characters.
SPLIT_CHARS = 1 << 15
#: No match of the pre-split pattern goes from a character that isn't white space into a single blank or
#: line end after it, nor from a letter or digit into a punctuation mark, and none looks back, so
#: encoding may restart there. The marks serve scripts without blanks.
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)|(?<=[^\W_])(?=[。、，！？；：।،؟])")
_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once per Python worker."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def pieces(text: str, limit: int = SPLIT_CHARS):
    """The text in parts that begin at safe boundaries; a part without one stays whole."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of the text without special tokens, as uint32; null counts as empty."""
    if not text:
        return np.zeros(0, np.uint32)
    parts = [np.asarray(enc.encode_to_numpy(p, disallowed_special=()), np.uint32) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(enc, ids: np.ndarray) -> bytes:
    """Raw bytes of the ids; they need not be valid UTF-8 if ids were cut."""
    return enc.decode_bytes(ids.tolist())


_KINDS = {
    "n_tokens": (T.LongType(), pa.int64(), lambda enc, ids, raw: len(ids)),
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.field("element", pa.int32(), nullable=False)), lambda enc, ids, raw: ids.astype(np.int32)),
    "decoded": (T.BinaryType(), pa.binary(), lambda enc, ids, raw: raw()),
    "ids_sha256": (T.StringType(), pa.string(), lambda enc, ids, raw: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda enc, ids, raw: hashlib.sha256(raw()).hexdigest()),
}


def bpe(docs: DataFrame, rank_path: str, pattern: str, outputs=("n_tokens", "ids"), text_col: str = "text") -> DataFrame:
    """Encodes every whole text and, where an output asks for it, decodes the ids again.

    outputs: of n_tokens, ids, decoded, ids_sha256, decoded_sha256; they replace input columns of
    the same name, the text column is dropped and the others pass through. Null and empty texts
    give no ids. rank_path must lead to the rank file on every executor. Rows are handled one by
    one within Arrow batches; nothing is shuffled.
    """
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in outputs]
    schema = T.StructType(rest + [T.StructField(o, _KINDS[o][0]) for o in outputs])

    def run(batches):
        enc = encoding(rank_path, pattern)
        for batch in batches:
            cols = {o: [] for o in outputs}
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                ids = encode(enc, text)
                memo: list[bytes] = []

                def raw(ids=ids, memo=memo):
                    if not memo:
                        memo.append(decode(enc, ids))
                    return memo[0]

                for o in outputs:
                    cols[o].append(_KINDS[o][2](enc, ids, raw))
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            arrays += [pa.array(cols[o], _KINDS[o][1]) for o in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return map_arrow(docs.select(*[f.name for f in rest], text_col), run, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256; nulls and repeats as in bpe()."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
