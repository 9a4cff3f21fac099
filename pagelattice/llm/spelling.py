"""Spelling variants by full neighbourhood generation.

For each word of a vocabulary all distinct deletions, replacements and insertions over the observed
alphabet are generated, and an equi-join of these strings with the vocabulary gives exactly the words
at one edit: no distance is computed. A word of length L over A characters has about 2 * L * A
candidates. They are hashed in bulk, and only those that a filter of the vocabulary may hold become
strings and are shuffled; the join on the strings settles what the filter lets through.

A word's join group is its neighbourhood, which its length and the alphabet bound, so no key is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, discard, map_arrow, partitions
from pagelattice.llm.filters import key_filter, may_hold

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: Candidates of one step in memory; distinct words that a task counts before it passes them on.
STEP, HELD = 1 << 20, 300_000


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)


def _length(n: int) -> np.uint64:
    """What a word's length adds to its hash."""
    return np.uint64(n * 0xD1342543DE82EF95 % (1 << 64))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]):
    """(length, positions of the words, their code points as rows) of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, STEP // ((int(n) + 1) * 64))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            yield int(n), part, _points([words[k] for k in part]).reshape(len(part), int(n))


def word_hashes(words: list[str]) -> np.ndarray:
    """Polynomial hash of each word's code points; candidates' hashes follow from those of their words."""
    out = np.zeros(len(words), np.uint64)
    for n, at, c in _by_length(words):
        out[at] = (c * _powers(n)[:n]).sum(axis=1, dtype=np.uint64) + _length(n)
    return out


def neighbours(words: list[str], alphabet: np.ndarray, keep) -> tuple[list[int], list[str]]:
    """The distinct strings one edit away from each word, as (position of the word, string), of those
    whose hashes keep says yes to. In a run of equal characters only the first is deleted, and one
    more is inserted behind it, so that no string comes twice."""
    where, found = [], []
    letters = [chr(int(a)) for a in alphabet]
    for n, at, c in _by_length(words):
        power = _powers(n + 1)
        prefix = np.zeros((len(at), n + 1), np.uint64)
        np.cumsum(c * power[:n], axis=1, dtype=np.uint64, out=prefix[:, 1:])
        total = prefix[:, n:]
        if n:
            gone = prefix[:, :n] + (total - prefix[:, 1:]) * _INVERSE + _length(n - 1)
            first = np.ones(c.shape, bool)
            first[:, 1:] = c[:, 1:] != c[:, :-1]
            for k, i in np.argwhere(keep(gone.ravel()).reshape(gone.shape) & first):
                w = words[at[k]]
                where.append(int(at[k]))
                found.append(w[:i] + w[i + 1 :])
        for i in range(n + 1):
            put = (prefix[:, i] + (total[:, 0] - prefix[:, i]) * np.uint64(_BASE) + _length(n + 1))[:, None] + alphabet * power[i]
            ok = keep(put.ravel()).reshape(put.shape)
            if i < n:
                ok &= alphabet != c[:, i : i + 1]
            for k, a in np.argwhere(ok):
                w = words[at[k]]
                where.append(int(at[k]))
                found.append(w[:i] + letters[a] + w[i:])
            if i < n:
                other = (total[:, 0] + _length(n))[:, None] + (alphabet - c[:, i : i + 1]) * power[i]
                ok = keep(other.ravel()).reshape(other.shape) & (alphabet != c[:, i : i + 1])
                for k, a in np.argwhere(ok):
                    w = words[at[k]]
                    where.append(int(at[k]))
                    found.append(w[:i] + letters[a] + w[i + 1 :])
    return where, found


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of words of a written vocabulary (word, n) that differ by one edit, both ways."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = np.sort(np.array([ord(r.c) for r in letters.toLocalIterator()], np.uint64))
    bits = key_filter(vocabulary.select("word"), lambda b: word_hashes(b.column(0).to_pylist()))
    shared = spark.sparkContext.broadcast((alphabet, bits))

    def run(batches):
        alphabet, bits = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                at, found = neighbours(part.column(0).to_pylist(), alphabet, lambda h: may_hold(bits, h))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in part.columns), pa.array(found, pa.string())], names=["word", "n", "near"])

    candidates = map_arrow(vocabulary.select("word", "n").repartition(partitions(vocabulary), "word"), run, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variants(vocabulary: DataFrame, factor: int = 10) -> DataFrame:
    """For each word of vocabulary (word string, n long): form, root, n, n_near, form_n.

    n_near counts the words one inserted, deleted or replaced code point away; form is the one of
    largest n (the smallest in code-point order of several) if its n is at least factor times the
    word's own, else null. root is the end of the chain of forms, the word itself if it has none; as n grows by
    the factor on each step, factor must be above 1 and chains are short. Null words are left
    out, words that come twice are one with the sum of their n, and other columns are ignored. An
    empty vocabulary gives no rows.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = cut(vocabulary.where("word is not null").groupBy("word").agg(F.sum(F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long"))).alias("n")))
    best = lambda near, n: F.struct((-F.col(n)).alias("less"), F.col(near).alias("form"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: bigint, form: string>").alias("best"))
    # one row a word and one a pair meet by word, so that no second join brings back words without any
    pairs = near_words(words).select("word", "n", F.lit(1).cast("long").alias("near"), best("near", "near_n").alias("best"))
    found = alone.unionByName(pairs).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= F.lit(factor) * F.col("n")
    found = cut(found.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    discard(words)
    # each round doubles how far along its chain every word has gone
    chain = cut(found.where("form is not null").select("word", F.col("form").alias("to"), F.lit(True).alias("moved")))
    while not chain.where("moved").isEmpty():
        step = chain.select(F.col("word").alias("to"), F.col("to").alias("next"))
        before, chain = chain, cut(chain.join(step, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        discard(before)
    out = found.join(chain.select("word", F.col("to").alias("end")), "word", "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
#: Latin-1 bytes: A-Z to lower case, all but letters to blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def runs(text: str | None, least: int) -> list[bytes]:
    """Maximal runs [A-Za-z\\u00C0-\\u00FF]+ of at least so many letters, A-Z in lower case, in Latin-1."""
    if not text:
        return []
    return [w for w in text.encode("latin-1", "replace").translate(_LOWER).split(b" ") if len(w) >= least]


def vocabulary(docs: DataFrame, least: int = 7, often: int = 2, slips: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts and how often they occur: word, n; at least `least` letters and `often` occurrences.

    With slips, a run whose crc32 of "<id>:<run>" slips divides loses the letter at crc32 % length, as a
    misspelling would. Null texts have no words, a null id reads as empty, rows that
    share an id all count, and other columns are ignored. Tasks count their texts first, so that a
    common word is a few rows.
    """

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                found = runs(text.as_py(), least)
                if not slips:
                    counts.update(found)
                    continue
                start = zlib.crc32(f"{'' if key.as_py() is None else key.as_py()}:".encode())
                for w, n in Counter(found).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % slips == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least:
                            continue
                    counts[w] += n
                if len(counts) > HELD:
                    yield flush()
                    counts.clear()
        yield flush()

    counted = map_arrow(docs.select(F.col(id_col).cast("string"), F.col(text_col)), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """All documents' words of at least 7 letters: word, form, root, n, n_near, form_n; nulls, ties and
    repeated rows as in vocabulary() and variants()."""
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), slips=31))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), each AS (
  SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(concat(doc_id, ':', w), ''),
      lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 + (unicode(s) >> 6) AS BIGINT), CAST(128 + (unicode(s) & 63) AS BIGINT)] END))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM each, crc
), word AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), less AS (
  SELECT DISTINCT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS d FROM word, range(1, 100) q(i) WHERE i <= length(word)
), pattern AS (
  SELECT word, n, concat(substr(word, 1, i - 1), '*', substr(word, i + 1)) AS d FROM word, range(1, 100) q(i) WHERE i <= length(word)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN word b ON a.d = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN word b ON a.d = b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM pattern a JOIN pattern b ON a.d = b.d AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS f, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN f END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM word w LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN formed f ON p.next = f.word
)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path p ON p.word = f.word AND p.next IS NULL
"""
