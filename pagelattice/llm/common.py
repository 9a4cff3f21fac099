"""Shared helpers: cut lineage, tokenise, hash shingles, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Java regex for a word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared checkpoint folder and reads it back.

    The folder is the one that spark.checkpoint.dir names; only where that is unset and Spark runs
    in one local process (tests) is it a temporary folder. The files survive lost executors and
    give later stages statistics and column pruning; the folder's owner expires them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = sc.getConf().get("spark.checkpoint.dir", None)
        if not set_dir and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="pagelattice-"))
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing lazy reads any more."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            jvm, jsc = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a batch that a function gets at a time: 10,000 long texts are too many for a worker.
BATCH = 8 << 20


def _pieces(batches):
    for b in batches:
        rows = max(1, b.num_rows * BATCH // max(b.nbytes, 1))
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this library's place added to the Python workers' path. On a cluster
    whose nodes don't have it there, ship the package with --py-files. run gets batches in pieces of
    about BATCH bytes, whatever size the session gives them."""
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))
    return df.mapInArrow(lambda batches: run(_pieces(batches)), schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that distinct inputs keep distinct outputs."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case. bytes.split() and bytes.lower() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hash of each run of `size` words; fewer words count as one shingle, none as nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MULTIPLIER + hashes[k : n - width + 1 + k]
    return mix64(out)


#: Bytes of a Bloom filter; beyond about its 8 million bits it lets more through, and stays right.
BLOOM = 1 << 20


def _bits(keys: np.ndarray) -> list[np.ndarray]:
    h = mix64(keys.view(np.uint64) + _MULTIPLIER)
    return [(h >> np.uint64(23 * k)) & np.uint64(8 * BLOOM - 1) for k in (0, 1)]


def bloom(df: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of a column of longs, of a fixed size: for passing over rows that a join
    would drop, before they are shuffled. Each task sends one filter, a few at a time."""

    def run(batches):
        bits = np.zeros(8 * BLOOM, bool)
        for b in batches:
            keys = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for at in _bits(keys):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def merge(batches):
        total = np.zeros(BLOOM, np.uint8)
        for b in batches:
            for x in b.column(0):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])

    each = map_arrow(df.select(F.col(col).cast("long")), run, "bits binary")
    few = map_arrow(each.coalesce(8), merge, "bits binary")
    total = np.zeros(BLOOM, np.uint8)
    for row in few.toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(total).astype(bool)


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _bits(keys)
    return bits[one] & bits[two]


def parted(df: DataFrame, col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose whole number in col may be one of ids, a table of one column, and the rows that surely have
    none, by a Bloom filter: only the first need be shuffled to be joined with ids. A null is none."""
    bits = df.sparkSession.sparkContext.broadcast(bloom(ids, ids.columns[0]))

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:
        hit = maybe_in(bits.value, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.array(hit & keys.is_valid().to_numpy(zero_copy_only=False))

    found = maybe(F.col(col).cast("long"))
    return df.where(found), df.where(~found)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node.

    Each round every node moves to the neighbour (or itself) with the smallest pseudo-random
    priority and the edges are relabelled, so that the graph shrinks by a constant factor
    whatever its shape; the chain of moves is then followed once. Rounds are joins and
    minimum aggregates that combine before their shuffle; only a row count per round reaches
    the driver. Null ends and loops are ignored, repeated edges count once.
    """
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = cut(live.where("a is not null and b is not null and a <> b").distinct())
    moves: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("p"), F.col(c).alias("n"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        move = cut(move.select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["n"].alias("to")))
        left, right = (move.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        step = live.join(left, "a").join(right, "b").where("a2 <> b2")
        before, live = live, cut(step.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        discard(before)
        moves.append(move)
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
        label = label.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    # priorities pick the root; the smallest member names the component
    least = label.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    out = cut(label.join(least, "to").select("node", "component"))
    discard(live, *moves)
    return out
