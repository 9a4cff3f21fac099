"""Phrase collocation mining with suffix arrays of word ids.

A task gathers its texts into shards of about SHARD words for each language. A shard's words become
ids, and prefix doubling sorts its suffixes by as many words as the longest phrase has. Neighbours
that share their first k words form an interval; its length is the shard's count of the phrase. Spark
adds up the shards' counts by phrase, which are few rows even for the commonest phrase.

Three passes keep rare phrases out of the shuffle, and lose nothing: a phrase that occurs `least` times has only
words and pairs of words that do. The first pass counts words, the second pairs of frequent words by a hash,
the third all phrases in which every pair is frequent; filters of the frequent words and pairs,
of a bounded size, cut the pieces of text where a phrase cannot go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, discard, map_arrow, mix64, partitions
from pagelattice.llm.filters import key_filter, may_hold

SHARD = 1 << 20
#: Pairs that a task holds before it sends them on; buckets of pairs for each shuffle partition.
HELD, BUCKETS = 2_000_000, 4
_BREAK = b"\xff"  # no byte of UTF-8 text
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _MARKS + b"\t", bytes(range(97, 123)) + _BREAK * len(_MARKS) + b" ")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, words int, phrase string, f long"


class _Ids(dict):
    """Ids of words in order of appearance, from 1; 0 is the end of a piece."""

    def __init__(self):
        self[_BREAK] = 0

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, with a mark between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _phrase_hashes(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each phrase from its words' hashes, one column for each place."""
    out = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for c in columns:
        out = out * _MULTIPLIER + c
    return mix64(out + np.uint64(len(columns)))


def _row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, np.uint64)
    for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        out[k] = _phrase_hashes(lang, [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")])[0]
    return out


def suffix_array(x: np.ndarray, words: int) -> np.ndarray:
    """Starts of the suffixes of x, sorted by at least their first `words` ids, by prefix doubling."""
    rank, width = x.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < words and len(x):
        second = np.zeros(len(x), np.int64)
        second[: max(0, len(x) - width)] = rank[width:]
        key = rank * (rank.max() + 1) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(len(x), np.int64)
        rank[order] = np.cumsum(np.append(1, ranked[1:] != ranked[:-1]))
        width *= 2
    return order


def interval_counts(x: np.ndarray, sizes: range):
    """(size, starts, counts): a start in x and the count of each distinct phrase that holds no 0."""
    most = sizes[-1]
    order = suffix_array(x, most)
    order = order[x[order] > 0]
    padded = np.append(x, np.zeros(most, x.dtype))
    length, common = np.zeros(len(order), np.int32), np.zeros(max(0, len(order) - 1), np.int32)
    inside, same = np.ones(len(length), bool), np.ones(len(common), bool)
    for t in range(most):
        at = padded[order + t]
        inside &= at > 0
        length += inside
        same &= inside[:-1] & (at[1:] == at[:-1])
        common += same
    for k in sizes:
        start = np.flatnonzero(np.append(True, common < k)) if len(order) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(order)))
        ok = length[start] >= k
        yield k, order[start[ok]], count[ok]


def _squeezed(x: np.ndarray, least: int) -> np.ndarray:
    """x without pieces of fewer than `least` words and with single zeros."""
    edge = np.flatnonzero(np.concatenate([[True], x == 0, [True]])) - 1
    size = np.diff(edge) - 1
    keep = np.repeat(size >= least, np.diff(edge))  # a piece goes with the zero after it
    return np.append(x, 0)[keep]


def _shards(batches):
    """(language, words, their hashes, ids) of each shard: ids of all its words in order, 0 between pieces, which
    are places in words and hashes."""

    def made(held):
        for lang, (ids, parts) in held.items():
            words = [None, *(w.decode() for w in ids if w != _BREAK)]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w != _BREAK else 0 for w in ids), np.uint64, len(ids))
            yield lang, words, hashes, np.concatenate(parts)

    held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids, parts = held.setdefault(lang, (_Ids(), []))
            found = tokens(text.as_py())
            parts += [np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), np.zeros(1, np.int64)]
            size += len(found)
            if size >= SHARD:
                yield from made(held)
                held, size = {}, 0
    yield from made(held)


def _counts(docs: DataFrame, sizes: range, pairs=None, buckets: int = 0) -> DataFrame:
    """Counts of phrases of some sizes by shard, summed: lang, words, phrase, f. Sizes of 1 come with
    a row of no words, which counts all of them. Phrases hold only pairs of words that the broadcast filter may hold."""

    def row(lang, words, phrases, counts):
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, words, np.int32)), phrases, pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "f"])

    def run(batches):
        for lang, words, hashes, x in _shards(batches):
            if sizes[0] == 1:
                yield row(lang, 0, pa.array([""]), np.array([np.count_nonzero(x)]))
            if pairs is not None and len(x) > 1:
                ok = may_hold(pairs.value, _pair_ids(_phrase_hashes(lang, [hashes[x[:-1]], hashes[x[1:]]]), buckets))
                x = _squeezed(np.insert(x, np.flatnonzero(~ok & (x[:-1] > 0) & (x[1:] > 0)) + 1, 0), sizes[0])
            names = pa.array(words, pa.string())
            for k, start, count in interval_counts(x, sizes):
                for s in range(0, len(start), 1 << 16):
                    some = start[s : s + (1 << 16)]
                    flat = names.take(pa.array(x[some[:, None] + np.arange(k)].ravel()))
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(some) + 1, k, dtype=np.int32)), flat), " ")
                    yield row(lang, k, joined, count[s : s + (1 << 16)])

    return map_arrow(docs, run, _COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _pair_ids(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits more of each hash, in one number."""
    return ((((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids and the sums of their counts."""
    i, c = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(i)
    i, c = i[order], c[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))[: len(i)]
    return i[start], np.add.reduceat(c, start) if len(start) else c


def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2**32, mostly small, byte by byte of equal weight, so that they pack well."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)


def _frequent_pairs(docs: DataFrame, least: int, frequent, buckets: int) -> DataFrame:
    """Ids of the pairs of words that occur at least `least` times, and by chance of a few others: id.

    Most pairs are rare, so they are counted by a hash, and tasks send sorted lists of hashes and counts
    by bucket, of three bytes or so each, instead of rows. frequent is a broadcast filter of words.
    """

    def listed(ids, counts):
        edges = np.append(np.flatnonzero(np.append(True, ids[1:] >> np.uint64(32) != ids[:-1] >> np.uint64(32)))[: len(ids)], len(ids))
        low = ids & np.uint64(0xFFFFFFFF)
        rows = [(int(ids[a]) >> 32, _planes(np.diff(low[a:z], prepend=np.uint64(0))), _planes(counts[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        for s in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 64], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "counts"])

    def count(batches):
        held, size = ([], []), 0
        for lang, _, hashes, x in _shards(batches):
            known = may_hold(frequent.value, _phrase_hashes(lang, [hashes]))
            known[0] = False
            x = _squeezed(np.where(known[x], x, 0), 2)
            for _, start, n in interval_counts(x, range(2, 3)):
                held[0].append(_pair_ids(_phrase_hashes(lang, [hashes[x[start]], hashes[x[start + 1]]]), buckets))
                held[1].append(n.astype(np.uint64))
                size += len(n)
            if size > HELD:
                ids, counts = _summed(*held)
                held, size = ([ids], [counts]), len(ids)
                if size > HELD:
                    yield from listed(ids, counts)
                    held, size = ([], []), 0
        if size:
            yield from listed(*_summed(*held))

    def add(batches):
        def enough(held):
            ids, counts = _summed(*held)
            return pa.RecordBatch.from_arrays([pa.array((ids[counts >= least]).view(np.int64))], names=["id"])

        bucket, held = None, ([], [])
        for b in batches:
            for k, ids, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held[0] and k != bucket:
                    yield enough(held)
                    held = ([], [])
                bucket = k
                held[0].append(np.cumsum(_numbers(ids)) | np.uint64(k << 32))
                held[1].append(_numbers(counts))
        if held[0]:
            yield enough(held)

    lists = map_arrow(docs, count, "bucket int, ids binary, counts binary").repartition(partitions(docs), "bucket").sortWithinPartitions("bucket")
    return map_arrow(lists, add, "id long")


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Counts of all phrases of 1 to `longest` words that occur at least `least` times within pieces, overlaps
    included, for each language: lang, words, phrase, f. A row of no words counts the language's words.

    Texts are put in lower case (A-Z only), cut into pieces at . , ; : ! ? and line ends, and these
    into words at blanks and tabs. A null language is `und`, a null or empty text has no words, repeated rows all
    count, and other columns are ignored. The result is a written table.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be at least 2 and least at least 1")
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    enough = lambda t: t.where((F.col("f") >= least) | (F.col("words") == 0))
    one = cut(enough(_counts(docs, range(1, 2))))
    frequent = broadcast(key_filter(one.where("words = 1").select("lang", "phrase"), _row_hashes))
    buckets = BUCKETS * partitions(docs)
    pairs = cut(_frequent_pairs(docs, least, frequent, buckets))
    may = broadcast(key_filter(pairs, lambda b: b.column(0).to_numpy().view(np.uint64)))
    more = cut(enough(_counts(docs, range(2, longest + 1), may, buckets)))
    out = cut(one.unionByName(more))
    discard(one, pairs, more)
    return out


def collocations(counts: DataFrame, top: int | None = 2000, share: int = 100) -> DataFrame:
    """Phrases of a table of phrases(), scored: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, n its language's number of words, l and r the counts of its two parts at the cut with the
    lowest score, floor(1000 * a * n / (l * r)) in whole numbers; of equal scores the first cut
    counts. A phrase goes whose words lie within a longer one that has at least `share` percent of its
    count. Each language's first `top` by score, count and phrase are ranked from 1; None keeps all.
    """
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(38,0)") * big("n")
    score = F.expr("product div parts")
    cuts = cuts.join(total, "lang").withColumns({"product": product.cast("decimal(38,0)"), "parts": (big("l") * big("r")).cast("decimal(38,0)")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # the parts of two words and more of every longer phrase, with the largest count of one they lie in
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.concat_ws(" ", F.slice("w", at, size)))))
    inner = candidates.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # first within slices of a language, so that no task sorts all its phrases
        slices = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(4 * partitions(kept))))
        kept = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    kept = kept if top is None else kept.where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents; nulls and repeats as in phrases()."""
    return collocations(phrases(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM piece
), gram AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, range(1, 6) q(k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, phrase, CAST(any_value(k) AS INTEGER) AS k, count(*) AS f FROM gram GROUP BY lang, phrase HAVING count(*) >= 100
), total AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang
), cand AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, a, n, j, x.f AS l, y.f AS r, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT lang, phrase, a, ws, k AS m, unnest(range(1, k)) AS j FROM cand) c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:m], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand))
  ) GROUP BY lang, phrase
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR longer < a
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY rank <= 2000
"""
