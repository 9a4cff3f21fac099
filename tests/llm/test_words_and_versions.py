"""Spelling variants, collocations and fingerprints against brute force, through operators and queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import collocations, fingerprints, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(spark, rows, path, extra=True):
    df = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOC)
    if extra:
        df = df.withColumns({c: F.lit(-1) for c in ("word", "n", "form", "phrase", "f", "words", "next", "none", "id", "hash", "stretch", "ahead", "place")})
    df.write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    words = [w for w in base for _ in range(30)]
    for w in base:  # edits of edits, so that forms chain
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k + 1 :]] * rng.randint(1, 3) + [w[:k] + rng.choice("aabÉ") + w[k:]] * rng.randint(1, 2)
    out = []
    for i in range(60):
        some = [rng.choice(words) for _ in range(40)] + ["the", "same", "few", "words", "again.", "the", "the", "the"]
        out.append((i, rng.choice([" ", "\n", ", "]).join(some).title() if i % 7 == 3 else " ".join(some), [None, "en", "und"][i % 3]))
    out += [(5, out[0][1], "en"), (5, out[1][1], None), (None, out[2][1], "en"), (None, None, None), (70, None, "en"), (71, "", None), (72, " \t\n", "en"), (73, "...", "xx"), (74, "abcdeéß" * 3000, "en"), (75, "a\tb  c", "en"), (76, "中文 text 中文 text\x0bmore", "en"), (77, "x" * 9 + " " + "x" * 10 + " " + "x" * 9 + " " + "x" * 10, "en")]
    return out


def brute_words(rows, least, often, slips):
    counts = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, factor=10):
    form, out = {}, {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if one_edit(w, x)]
        if near and -min(near)[0] >= factor * n:
            form[w] = min(near)[1]
        out[w] = [n, len(near)]
    for w in out:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, *out[w], counts.get(form.get(w)))
    return out


def test_spelling_query(spark, rows, tmp_path):
    path = written(spark, rows, tmp_path)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling(spark, path).collect()}
    want = brute_variants(brute_words(rows, 7, 2, 31))
    assert got == want
    assert sum(w[0] is not None for w in want.values()) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    named = [r for r in rows if r[0] is not None]
    assert {r[0]: tuple(r[1:]) for r in con.sql(spelling.OP11_SQL).fetchall()} == brute_variants(brute_words(named, 7, 2, 31))


def test_spelling_of_any_words(spark):
    """Ties go to the smallest form; words of one letter, none, other scripts and beyond the plane; sums of repeated rows."""
    counts = {"": 1, "a": 10, "b": 10, "ab": 1, "aab": 2, "aaab": 30, "猫": 3, "猫犬": 1, "😀x": 4, "x": 1, "y" * 300: 50, "y" * 301: 5, "qrs": 1, "qrst": 10, "qrstu": 100, "qrstuv": 1000, "qrstuvw": 9999}
    table = spark.createDataFrame([*counts.items(), ("aab", 0), ("x", None), (None, 7)], "word string, n long").withColumn("near", F.lit(1))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    assert got == brute_variants(counts)
    assert got["qrs"][:2] == ("qrst", "qrstuv") and got["ab"][0] == "a"
    assert spelling.variants(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(table, factor=1)


def test_neighbours_are_all_and_distinct():
    letters = np.array([ord(c) for c in "abé"], np.uint64)
    for w in ("", "a", "aab", "éaab", "bbbb"):
        at, found = spelling.neighbours([w], letters, lambda h: np.ones(len(h), bool))
        want = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for c in "abé" for k in range(len(w) + 1)} | {w[:k] + c + w[k + 1 :] for c in "abé" for k in range(len(w))} - {w}
        assert sorted(found) == sorted(want) and not any(at)
        hashes = []
        spelling.neighbours([w], letters, lambda h: hashes.append(h) or np.ones(len(h), bool))
        assert set(spelling.word_hashes(found).tolist()) <= set(np.concatenate(hashes).tolist())


def brute_phrases(rows, longest, least):
    f, n = {}, Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOW)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return {g: {p: c for p, c in x.items() if c >= least} for g, x in f.items()}, n


def brute_collocations(rows, longest, least, top):
    counts, total = brute_phrases(rows, longest, least)
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or any(b == a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items() if len(q) > len(p)):
                continue
            score, _, cut = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, (f[p[:k]], f[p[k:]])) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), *cut))
        out += [(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top", [(5, 3, 2000), (2, 2, 7), (3, 40, None)])
def test_collocations(spark, rows, longest, least, top, monkeypatch):
    df = spark.createDataFrame([(t, g, 1) for _, t, g in rows], "text string, lang string, f long")
    counts = collocations.phrases(df, longest, least)
    want, total = brute_phrases(rows, longest, least)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.where("words > 0").collect()} == {(g, p): c for g, x in want.items() for p, c in x.items()}
    assert {r.lang: r.f for r in counts.where("words = 0").collect() if r.f} == {g: n for g, n in total.items() if n}
    assert sorted(map(tuple, collocations.collocations(counts, top).collect())) == brute_collocations(rows, longest, least, top)


def test_collocation_query_and_sql(spark, rows, tmp_path):
    many = rows * 4
    path = written(spark, many, tmp_path)
    got = sorted(map(tuple, collocations.op12_collocations(spark, path).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got and got == brute_collocations(many, 5, 100, 2000) == sorted(con.sql(collocations.OP12_SQL).fetchall())
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(collocations.phrases(empty)).collect() == []


def test_large_scores_are_exact(spark):
    a, n = 3 * 10**12 + 7, 10**14 + 39
    counts = spark.createDataFrame([("x", 0, "", n), ("x", 1, "p", a + 1), ("x", 1, "q", a), ("x", 2, "p q", a)], "lang string, words int, phrase string, f long")
    assert collocations.collocations(counts).first().score == 1000 * a * n // ((a + 1) * a)


def test_suffix_intervals():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 500):
        x = rng.integers(0, 5, size)
        got = {(k, tuple(x[s : s + k].tolist())): int(c) for k, at, n in collocations.interval_counts(x, range(1, 6)) for s, c in zip(at, n, strict=True)}
        assert got == Counter((k, tuple(x[s : s + k].tolist())) for k in range(1, 6) for s in range(size - k + 1) if all(x[s : s + k]))


def brute_likeness(a, b):
    a, b = Counter(fingerprints.pieces(a)), Counter(fingerprints.pieces(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprint_query(spark, rows, tmp_path):
    texts = [(i, t, g) for i, t, g in rows if i is not None and i != 5]
    texts += [(100 + k, "\n".join(f"line {j} of {k // 2}, more" for j in range(k * 7)), "en") for k in range(40)] + [(200, "Same. " * 500, "en"), (201, "Same. " * 400, "en"), (202, "ab", "en"), (203, "😀é" * 50, "en")]
    random.Random(2).shuffle(texts)
    path = written(spark, texts, tmp_path)
    got = {r.doc_id: r for r in fingerprints.op13_fingerprints(spark, path).collect()}
    order = sorted((i, t or "") for i, t, _ in texts)
    assert len(got) == len(order)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited, r = t[: len(t) - half] + after[:half], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(brute_likeness(t, edited)) and r.near_next == pytest.approx(brute_likeness(t, after))
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fingerprints.Versions([t, edited]).fingerprints())
    prints = {}
    for i, t in order:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_of_odd_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    odd = [(None, "one. two", "en"), (None, None, "en"), (4, "x. y", "en"), (4, "x. z", "en"), (4, "x. y", "en")]
    got = fingerprints.op13_fingerprints(spark, written(spark, odd, tmp_path / "a")).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 4)] * 3 + [(True, 0), (True, 8)]
    (tmp_path / "b").mkdir()
    assert fingerprints.op13_fingerprints(spark, written(spark, [], tmp_path / "b")).collect() == []
    (tmp_path / "c").mkdir()
    alone = fingerprints.op13_fingerprints(spark, written(spark, [(1, "a. b. c", "en")], tmp_path / "c")).first()
    assert alone.near_next == 1.0


def test_compare_recovers_differences(spark):
    rng = random.Random(4)
    pairs = []
    for k in range(30):
        a = [f"piece {rng.randrange(40)}." for _ in range(k * 6)]
        b = [p for p in a if rng.random() < 0.8] + [f"new {j}." for j in range(rng.randrange(4))]
        pairs.append((k, " ".join(a), "\n".join(b)))
    pairs += [(50, None, None), (51, "", "a"), (52, "x" * 100_000, "x" * 99_999)]
    df = spark.createDataFrame(pairs, "k int, a string, b string").withColumn("cells", F.lit("old"))
    for r in fingerprints.compare(df, "a", "b").collect():
        one, two = (fingerprints.Versions([t or ""]) for t in (r.a, r.b))
        left, right = (set(v.key.view(np.int64).tolist()) for v in (one, two))
        assert (set(r.only_left), set(r.only_right)) == (left - right, right - left)
        assert (len(r.only_left), len(r.only_right)) == (len(left - right), len(right - left)) and r.cells >= fingerprints.CELLS
        assert r.likeness == pytest.approx(brute_likeness(r.a or "", r.b or ""))
    assert fingerprints.compare(df.limit(0), "a", "b").collect() == []
