"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are the pieces between line ends and after marks that end a sentence or a clause, so that
an edit costs the pieces it touches. Each has a 64-bit digest; the k-th repeat of a piece has a digest of its own. A
sketch has three tables of cells; every digest adds itself, a check value and one to the count of a cell in each.

The sketches of two versions subtract cell by cell, and what both have cancels out. A cell that is left
with one digest (its check value says so) gives it up; taking it out of its other cells frees
more, until all differing digests are recovered. Where some are left, both versions are sketched
again with twice as many cells and another hash. All pairs of a batch are peeled together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import map_arrow, mix64, partitions

#: Cells of a fingerprint: three tables of eight.
CELLS = 24
TABLES = 3
_PIECE = re.compile(r"[^\n.!?;:,]+[.!?;:,]*|[.!?;:,]+")
_CELL = np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")])
_STEP = 0xD1342543DE82EF95
_CHECK = np.uint64(0x2545F4914F6CDD1D)


def pieces(text: str) -> list[str]:
    """Paragraphs of a text without the blanks around them."""
    return [p for p in map(str.strip, _PIECE.findall(text)) if p]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every piece of the texts, all distinct within a text."""
    found = [np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in pieces(t)), np.uint64) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    key = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    repeat = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return doc, mix64(key + repeat.astype(np.uint64) * np.uint64(_STEP))


class Sketches:
    """Sketches of many texts with m cells each, side by side in flat arrays."""

    def __init__(self, texts: int, m: int):
        self.m, self.third = m, m // TABLES
        self.count, self.key, self.check = np.zeros(texts * m, np.int64), np.zeros(texts * m, np.uint64), np.zeros(texts * m, np.uint32)

    def checks(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key ^ _CHECK) >> np.uint64(32)).astype(np.uint32)

    def places(self, at: np.ndarray, key: np.ndarray):
        """The cell in each table, of digests of texts number `at`; each size has its own hash."""
        for j in range(TABLES):
            h = mix64(key + np.uint64((self.m * TABLES + j) * _STEP % (1 << 64)))
            yield at * self.m + j * self.third + (((h >> np.uint64(32)) * np.uint64(self.third)) >> np.uint64(32)).astype(np.int64)

    def add(self, at: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        plus, check = sign > 0, self.checks(key)
        key, check = np.where(plus, key, -key), np.where(plus, check, -check)
        for cell in self.places(at, np.where(plus, key, -key)):
            np.add.at(self.count, cell, sign)
            np.add.at(self.key, cell, key)
            np.add.at(self.check, cell, check)
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.m)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, digest, sign) of what can be recovered, and which texts are left with nothing else."""
        found: list[tuple[np.ndarray, ...]] = []
        for _ in range(64 + self.m):
            cell = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[cell]
            key = np.where(sign > 0, self.key[cell], -self.key[cell])
            ok = np.where(sign > 0, self.check[cell], -self.check[cell]) == self.checks(key)
            if not ok.any():
                break
            at, key, sign = cell[ok] // self.m, key[ok], sign[ok]
            order = np.lexsort((key, at))  # a digest alone in several cells comes once
            at, key, sign = at[order], key[order], sign[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
            found.append((at[new], key[new], sign[new]))
            self.add(at[new], key[new], -sign[new])
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(-1, self.m).any(axis=1)
        at, key, sign = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))
        return at, key, sign, done

    def text(self, k: int, n: int) -> str:
        """The fingerprint of text number k, of n pieces."""
        part = slice(k * self.m, (k + 1) * self.m)
        cells = np.empty(self.m, _CELL)
        cells["count"], cells["key"], cells["check"] = self.count[part].astype(np.int16), self.key[part], self.check[part]
        return base64.b64encode(np.int64(n).tobytes() + cells.tobytes()).decode()


class Versions:
    """Digests of a batch of texts, and their sketches of any size."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.doc, self.key = digests(texts)
        self.size = np.bincount(self.doc, minlength=self.n)
        self.ends = np.append(0, np.cumsum(self.size))

    def sketches(self, m: int, of: np.ndarray | None = None) -> Sketches:
        """Sketches of all texts, or of the texts numbered `of` in this order."""
        if of is None:
            return Sketches(self.n, m).add(self.doc, self.key)
        size = self.size[of]
        at = np.repeat(np.arange(len(of)), size)
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return Sketches(len(of), m).add(at, self.key[np.repeat(self.ends[of], size) + within])

    def fingerprints(self, cells: int = CELLS) -> list[str]:
        s = self.sketches(cells)
        return [s.text(k, int(self.size[k])) for k in range(self.n)]


def differences(left: Versions, right: Versions, a: np.ndarray, b: np.ndarray, cells: int = CELLS):
    """Recovers what texts a of left and b of right don't share: (pair number, digest, sign) with sign 1
    for what only left has, and the number of cells that each pair took in the end."""
    todo, m = np.arange(len(a)), cells
    took, found = np.zeros(len(a), np.int64), []
    while len(todo):
        step = max(1, (1 << 21) // m)  # cells of one step in memory
        failed = []
        for s in range(0, len(todo), step):
            some = todo[s : s + step]
            at, key, sign, done = left.sketches(m, a[some]).minus(right.sketches(m, b[some])).peel()
            ok = done[at]
            found.append((some[at[ok]], key[ok], sign[ok]))
            took[some[done]] = m
            failed.append(some[~done])
        todo, m = np.concatenate(failed), 2 * m
    pair, key, sign = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))
    return pair, key, sign, took


def likeness(left: Versions, right: Versions, a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Shared pieces over all pieces of both, by the recovered differences; 1 where neither has any."""
    pair, _, sign, _ = differences(left, right, a, b, cells)
    gone, new = (np.bincount(pair[sign == s], minlength=len(a)) for s in (1, -1))
    total = left.size[a] + new
    return np.where(total > 0, (left.size[a] - gone) / np.maximum(total, 1), 1.0)


def _small(batches: Iterable[pa.RecordBatch], chars: int = 1 << 22):
    """The batches in pieces of about so many bytes of text."""
    for b in batches:
        rows = max(1, int(b.num_rows * chars / max(b.nbytes, 1)))
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def compare(pairs: DataFrame, left_col: str, right_col: str, cells: int = CELLS) -> DataFrame:
    """pairs with what their two texts don't share: fingerprint_left, fingerprint_right, only_left and only_right
    (digests as longs, in no order), cells (that it took to recover them) and likeness (0 to 1).

    Null texts count as empty; two texts without pieces are alike (1.0). Columns of these names
    are replaced, the others pass through. Rows are handled within Arrow batches; nothing is shuffled.
    """
    new = "fingerprint_left string, fingerprint_right string, only_left array<bigint>, only_right array<bigint>, cells long, likeness double"
    names = [c.split()[0] for c in new.split(", ")]
    rest = [c for c in pairs.columns if c not in names]
    texts = pairs.select(*rest, F.coalesce(left_col, F.lit("")).alias("_left"), F.coalesce(right_col, F.lit("")).alias("_right"))

    def run(batches):
        for b in _small(batches):
            left, right = (Versions(b.column(b.num_columns - k).to_pylist()) for k in (2, 1))
            at = np.arange(b.num_rows)
            pair, key, sign, took = differences(left, right, at, at, cells)
            lists = []
            for s in (1, -1):
                some = np.flatnonzero(sign == s)
                some = some[np.argsort(pair[some], kind="stable")]
                ends = np.append(0, np.cumsum(np.bincount(pair[some], minlength=b.num_rows))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].view(np.int64))))
            gone, more = (np.diff(x.offsets.to_numpy()) for x in lists)
            total = left.size + more
            share = np.where(total > 0, (left.size - gone) / np.maximum(total, 1), 1.0)
            columns = [*b.columns[:-2], pa.array(left.fingerprints(cells)), pa.array(right.fingerprints(cells)), *lists, pa.array(took), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*rest).schema.fields), new])
    return map_arrow(texts, run, schema)


def followed(docs: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """run over batches (doc_id, text, next) of all rows, where next is the text of the following row in
    order of id, and of the first row after the last.

    Rows that share an id follow a hash of their texts, null ids come last and null texts read as
    empty. Texts are shuffled once, into stretches of this order, and the first row of each stretch goes to the one before
    it too. Only these first keys, one for each stretch, pass through the driver.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = [F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("hash")]
    order = ["none", "id", "hash"]
    stretches = docs.select(*key).repartitionByRange(partitions(docs), *order).groupBy(F.spark_partition_id().alias("stretch"))
    firsts = sorted(tuple(r.first) for r in stretches.agg(F.min(F.struct(*order)).alias("first")).collect())
    if not firsts:
        return map_arrow(docs.withColumn("next", F.col("text")), run, schema)
    types = [(c, "i8") for c in order]
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(firsts, types))

    @F.pandas_udf("stretch int, first boolean")
    def place(none: pd.Series, number: pd.Series, code: pd.Series) -> pd.DataFrame:
        keys = np.empty(len(none), types)
        keys["none"], keys["id"], keys["hash"] = none, number, code
        at = np.searchsorted(bounds.value, keys, "right") - 1
        return pd.DataFrame({"stretch": at.astype(np.int32), "first": bounds.value[at] == keys})

    rows = docs.select("*", *key).withColumn("place", place(*order))
    own = F.struct(F.col("place.stretch").alias("stretch"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("place.stretch") - 1, F.lit(len(firsts))).alias("stretch"), F.lit(True).alias("ahead"))
    dealt = rows.select("doc_id", "text", *order, F.inline(F.when(F.col("place.first"), F.array(own, before)).otherwise(F.array(own))))
    listed = dealt.repartitionById(len(firsts), F.col("stretch")).sortWithinPartitions("stretch", "ahead", *order)

    def with_next(batches):
        last = None
        for b in batches:
            b = b.select(["doc_id", "text", "ahead"])
            rows = pa.Table.from_batches([b] if last is None else [last, b])
            last = b.slice(b.num_rows - 1)
            this, after = rows.slice(0, rows.num_rows - 1), rows.slice(1)
            whole = pa.table({"doc_id": this["doc_id"], "text": this["text"], "next": after["text"]}).filter(pc.invert(this["ahead"]))
            yield from whole.combine_chunks().to_batches()

    return map_arrow(listed.select("doc_id", "text", "ahead"), lambda batches: run(with_next(batches)), schema)


_OP13 = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts; nulls, ties and repeats as in followed() and likeness()."""

    def run(batches):
        for b in _small(batches):
            texts, nexts = b.column(1).to_pylist(), b.column(2).to_pylist()
            half = [len(t) // 2 for t in texts]
            edited = [t[: len(t) - h] + n[:h] for t, h, n in zip(texts, half, nexts, strict=True)]
            old, new, other = Versions(texts), Versions(edited), Versions(nexts)
            at = np.arange(len(texts))
            columns = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string())]
            columns += [pa.array(v.fingerprints(), pa.string()) for v in (old, new)]
            columns += [pa.array(likeness(old, v, at, at), pa.float64()) for v in (new, other)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OP13.split(", ")])

    return followed(spark.read.parquet(f"{sf_dir}/documents.parquet"), run, _OP13)
