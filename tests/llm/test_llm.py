"""The training-data operators against brute force, on small rows with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import bpe, chat, common, ctw, mixing, neardup, substring, tiff, toxicity, vectors, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "bra") for b in ("ne", "ri", "sto", "va", "x", "ling", "du")]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    out = []
    for k in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() + "," if rng.random() < 0.1 else w + "." if k % 9 == 8 else w)
    return " ".join(out)


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", None if i is not None and i % 5 == 4 else f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"size": F.lit(1), "score": F.lit("x"), "n": F.lit(2)}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(60)]
    texts = [(k, t) for k, t in enumerate(base)]
    near = base[0].split()
    for k in range(60, 75):
        w = list(near)
        for _ in range(3):
            w[rng.randrange(len(w))] = "changed"
        texts.append((k, " ".join(w)))
    texts += [(75, base[1]), (76, base[1].upper()), (77, ""), (78, None), (79, " \t\n"), (80, "two words"), (81, "Two  words"), (82, "a" * 5000), (83, base[2] + "\n" + base[3]), (None, base[4]), (None, None)]
    return texts


def union(n):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    return find, join


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(200, k) for k in range(201, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7), (None, 3), (3, None)]
    find, join = union(0)
    for a, b in edges:
        if a is not None and b is not None:
            join(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_has_no_misses(spark):
    bits = common.bloom(spark.range(1000), "id")
    assert common.maybe_in(bits, np.arange(1000)).all()
    assert common.maybe_in(bits, np.arange(10**6, 10**6 + 1000)).mean() < 0.01


def test_mix(spark, corpus, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs(spark, corpus, extra=False).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(con.sql(mixing.OP1_SQL).fetchall(), key=key)
    got = sorted((tuple(r) for r in mixing.op1_mix(spark, str(tmp_path)).collect()), key=key)
    assert got == want
    by = {}
    for (i, _), r in zip(sorted(corpus, key=lambda x: (x[0] is None, str(x[0]))), got, strict=True):
        assert 0 <= r[4] <= 2 * r[1]
    clashing = docs(spark, corpus).withColumns({c: F.lit(-1) for c in ("size", "start", "times", "target", "weight", "rate", "at", "row", "h", "pass", "finish", "bucket")})
    for r in mixing.schedule(clashing).collect():
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    stream = mixing.mix(clashing).collect()
    assert len(stream) == sum(r.times for rows in by.values() for r in rows) and stream[0].__fields__ == clashing.columns
    taken = {}
    for r in stream:
        assert {r[c] for c in clashing.columns[8:]} | {r.size} == {-1}
        taken[r.doc_id, r.text] = taken.get((r.doc_id, r.text), 0) + len((r.text or "").encode().split())
    assert sorted(taken.values()) == sorted(r.taken for rows in by.values() for r in rows if r.taken)
    assert [(r.doc_id, r.text) for r in mixing.mix(clashing).collect()] == [(r.doc_id, r.text) for r in stream]
    assert mixing.mix(docs(spark, [])).count() == 0


def test_tiff_schemes(spark):
    rng = np.random.default_rng(2)
    for dtype in (np.uint8, np.uint16):
        for shape in ((37, 50), (20, 33, 3), (1, 1)):
            a = (rng.integers(0, 4, shape) * 60).astype(dtype)
            for scheme in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
                for predictor in (1, 2):
                    for tile in (None, (16, 16)):
                        for order in "<>":
                            blob = tiff.write_tiff([a, a], scheme, predictor, 7, tile, order)
                            pages = [p for p, _, _ in tiff.read_pages(blob)]
                            assert len(pages) == 2 and all((p.reshape(shape) == a).all() for p in pages)
    noise = rng.integers(0, 256, (90, 700)).astype(np.uint8)
    assert (next(tiff.read_pages(tiff.write_tiff([noise], tiff.LZW, 1)))[0][:, :, 0] == noise).all()
    df = spark.createDataFrame([(1, bytearray(tiff.write_tiff([noise, noise]))), (2, None), (3, bytearray(b"no tiff")), (4, bytearray(b"II*\0"))], "id int, media binary")
    got = [(r.id, r.page, r.error is None) for r in tiff.pages(df).orderBy("id", "page").collect()]
    assert got == [(1, 0, True), (1, 1, True), (3, -1, False), (4, -1, False)]


def test_tiff_documents(spark, corpus):
    text = dict(enumerate(t for _, t in corpus))
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    for r in tiff.documents(df, media=True).collect():
        raw = (text[r.doc_id] or "").encode()
        raw_p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(raw_p), hashlib.sha256(raw_p).hexdigest(), zlib.crc32(raw_p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_groups(texts):
    find, join = union(0)
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    for a, x in sets:
        for b, y in sets:
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                join(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def test_near_duplicates(spark, corpus):
    got = neardup.groups(docs(spark, corpus)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_groups(corpus)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert len(got) == len(corpus) and neardup.groups(docs(spark, [])).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(120)]
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"edit{rng.random()}"
        texts.append((k, " ".join(w)))
    shared = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [(1000 + k, shared + " " + " ".join(f"own{rng.random()}" for _ in range(100))) for k in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_lists_that_the_sort_splits_still_meet(spark):
    rng = random.Random(12)
    rows = [(v, rng.randint(0, 9), 0, 100 * v + k, 10) for v in range(60) for k in range(rng.choice([1, 2, 5, 8]))]
    df = spark.createDataFrame(rows, "v long, c1 long, c2 long, node long, n long")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[3])
    want = {(a, b) for nodes in by.values() for a in nodes for b in nodes if a < b}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert {(r.a, r.b) for r in neardup.meeting_pairs(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_ctw(train, texts, depth=5):
    """A recursive context tree in plain Python: log10 P of each text under the training texts."""
    count = {}
    for t in train:
        past = b"\n" * depth
        for c in t:
            for d in range(depth + 1):
                for k in range(8):
                    node = past[depth - d :], k, c >> (8 - k)
                    count.setdefault(node, [0, 0])[(c >> (7 - k)) & 1] += 1
            past = past[1:] + bytes([c])
    children = {}
    for context, k, bits in count:
        if context:
            children.setdefault((context[1:], k, bits), []).append((context, k, bits))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    own, logs = {}, {}
    for node in sorted(count, key=lambda x: -len(x[0])):
        logs[node] = kt(*count[node])
        own[node] = 1.0
        if len(node[0]) < depth:
            split = sum(logs[x] for x in children[node])
            own[node] = 1 / (1 + math.exp(min(split - logs[node], 700)))
            logs[node] = np.logaddexp(logs[node], split) - math.log(2)

    def one(past, k, bits, d=0):
        node = past[depth - d :], k, bits
        if node not in count:
            return None
        n0, n1 = count[node]
        here, below = (n1 + 0.5) / (n0 + n1 + 1), one(past, k, bits, d + 1) if d < depth else None
        return here if below is None else own[node] * here + (1 - own[node]) * below

    out = []
    for t in texts:
        past, total = b"\n" * depth, 0.0
        for c in t:
            for k in range(8):
                p = one(past, k, c >> (8 - k))
                p = 0.5 if p is None else p
                total += math.log10(p if (c >> (7 - k)) & 1 else 1 - p)
            past = past[1:] + bytes([c])
        out.append(total)
    return out


def test_strings_restart_at_each_text(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 2)
    got = [(int(i), int(c).to_bytes(6, "big")) for text, code in ctw.Strings([b"ab\n", b"c\n"]).slices() for i, c in zip(text, code)]
    assert got == [(0, b"\n\n\n\n\na"), (0, b"a\n\n\n\nb"), (0, b"ba\n\n\n\n"), (1, b"\n\n\n\n\nc"), (1, b"c\n\n\n\n\n")]


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.5, 10.0, 1234.5])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_language_model(spark, corpus):
    df = docs(spark, corpus).withColumns({c: F.lit(1) for c in ("a", "b", "g", "kind", "block", "learn")})
    got = ctw.score(df, ~ctw.held_out()).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t in corpus:
        for w in [] if held(i) else [*(t or "").encode().lower().split(), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    text = {i: t for i, t in corpus if i is not None}
    streams = {i: ctw.stream((t or "").encode().lower().split()) for i, t in text.items()}
    ids = [i for i in streams if len(streams[i]) < 400 or i in (60, 82)]
    train = [ctw.stream((t or "").encode().lower().split()) for i, t in corpus if not held(i)]
    want = dict(zip(ids, plain_ctw(train, [streams[i] for i in ids]), strict=True))
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            w = [*(text[r.doc_id] or "").encode().lower().split(), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
            assert abs(r.base_score - sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6
            assert r.doc_id not in want or abs(r.score - want[r.doc_id]) < 1e-4
    other = spark.createDataFrame([(k, "xyzzy " * 30) for k in range(20)], "doc_id long, text string")
    probe = spark.createDataFrame([(99, "xyzzy xyzzy")], "doc_id long, text string")
    same = lambda extra: [r.score for r in ctw.score(extra.select("doc_id", "text").union(probe), F.col("doc_id") != 99).collect() if r.doc_id == 99][0]
    assert same(other) == same(other) > same(df.where("doc_id < 50"))
    assert abs(ctw.score(probe, F.lit(False)).first().score - 12 * 8 * math.log10(0.5)) < 1e-4


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [(k, prose(rng, 60) + (" vile " + prose(rng, 20) + " rotten" if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, ""), (None, "vile rotten")]
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (901, 0, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert len(got) == len(texts) and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    none = toxicity.score(df, toxicity.fit(df, labels.where("false")))
    assert none.where("predicted = 1").count() == 0


def test_substring(spark):
    rng = random.Random(8)
    passage = " ".join(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w for k, w in enumerate(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(63)))
    own = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" + ("." if k % 7 == 6 else "") for k in range(n))
    texts = [(k, own(49) + " " + passage + " " + own(35)) for k in (3, 9, 12)] + [(k, own(80)) for k in range(20, 40)]
    block = own(60).replace(".", "")
    changed = block.split()
    changed[30] = "other"
    texts += [(50, own(30) + "\n" + block + "\n" + own(20)), (51, own(28) + "\n" + " ".join(changed) + "\n" + own(20)), (60, None), (61, ""), (None, passage), (62, "one")]
    text = {i: t for i, t in texts if i is not None}
    df = docs(spark, texts)
    rows = substring.passages(df).collect()
    gone = {}
    for r in rows:
        if r.removed:
            gone.setdefault(r.doc_id, []).append(text[r.doc_id][r.start : r.end])
    assert {r.doc_id for r in rows} == {3, 9, 12, 50, 51} and gone[9] == gone[12] == [passage] and set(gone) == {9, 12, 51}
    assert gone[51] == [" ".join(changed)]
    out = {r.doc_id: r for r in substring.dedup(df, length_col="n_chars").collect()}
    assert out[3].text == text[3] and passage not in out[9].text and out[9].n_chars == len(out[9].text) == len(text[9]) - len(passage)
    assert all(out[i].text == text[i] for i in text if i not in gone) and len(out) == len({i for i, _ in texts})
    assert substring.passages(docs(spark, [])).count() == 0


def test_passages_that_begin_and_end_within_sentences(spark):
    rng = random.Random(18)
    word = lambda: rng.choice(WORDS) + str(rng.randint(0, 999))
    text = lambda n: " ".join(word() + ("." if k % 25 == 24 else "") for k in range(n))
    texts, planted = [], {}
    for k in range(120):
        passage = " ".join(word() for _ in range(rng.randint(51, 70)))
        planted[2 * k + 1] = passage
        texts += [(2 * k, text(rng.randint(20, 60)) + " " + passage + " " + text(40)), (2 * k + 1, text(rng.randint(20, 60)) + " " + passage + " " + text(40))]
    rows = substring.passages(docs(spark, texts)).where("removed").collect()
    text_of = dict(texts)
    found = {r.doc_id: max(len((text_of[r.doc_id][r.start : r.end]).split()), 0) for r in rows if text_of[r.doc_id][r.start : r.end] in planted.get(r.doc_id, "")}
    # simulated: 0.96 of passages of 51 words in sentences of 15 to 35, all of those of 63 words
    assert len(found) >= 0.92 * len(planted) and all(r.doc_id in found for r in rows)


def test_winnowing_chooses_by_content():
    rng = random.Random(4)
    passage = [str(rng.random()) for _ in range(51)]
    seen = []
    for n in (0, 30, 77):
        w = substring.Words(" ".join([str(rng.random()) for _ in range(n)] + passage + [str(rng.random()) for _ in range(40)]))
        at = w._winnowed()
        assert np.diff(at).max() <= substring.SPREAD
        seen.append({int(x) - n for x in at if n + substring.SPREAD <= x < n + 51 - substring.SPREAD})
    assert seen[0] == seen[1] == seen[2]
    assert len(substring.Words("a b")._winnowed()) == 0


def test_repeated_runs_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5 + k]), rng.randint(1, 40), k, k + 1, k, k + 1) for k in range(800)]
    df = spark.createDataFrame(rows, "node long, doc_id long, sw int, ew int, start int, end int").withColumn("version", F.col("doc_id") % 3).coalesce(1)
    by = {}
    for r in rows:
        by.setdefault(r[0], set()).add(r[1])
    want = sorted((r[1], r[1] % 3, r[2], r[0], min(by[r[0]])) for r in rows if len(by[r[0]]) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = sorted((r.doc_id, r.version, r.sw, r.cluster_id, r.first_doc) for r in substring._repeated(df, []).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_bpe(spark, corpus):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path(bpe.RANK_FILE)
    enc = bpe.encoding(path, tokenizers.PATTERN)
    odd = ["x " * 60000, "\n" * 70000 + "a", "it's  'll\t\t b", "é" * 40000, "слово не воробей, и " * 4000, "汉字。文字，" * 9000, "مرحبا بكم " * 5000, "a\n" * 40000, "x.\ny' s" * 9000, "½。" * 20000, "<|endoftext|>", "🙂 мир"]
    texts = [t for _, t in corpus] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in bpe.bpe(df, path, tokenizers.PATTERN, ("n_tokens", "ids", "decoded", "ids_sha256")).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_chat(spark):
    rng = random.Random(2)
    turns = {}
    for c in range(12):
        n = rng.randint(1, 40)
        turns[c] = [("system" if k == 0 and c % 2 else "user" if k % 2 else "assistant", prose(rng, rng.randint(0, 90))) for k in range(n)]
    turns[20] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<|turn|>a\\<|end|>\\\\[INST]<<SYS>> \\ <|text|>\n")]
    turns[22] = [("system", prose(rng, 60)), *((("user", "assistant")[k % 2], prose(rng, rng.randint(5, 50))) for k in range(30))]
    turns[23] = [("system", "alone")]
    turns[21] = [("", ""), ("assistant", ""), ("role\nwith <|text|>", "x" * 9000)]
    turns[None] = [("user", "hi"), ("assistant", "there")]
    rows = [(c, k, r, t, 1) for c, v in turns.items() for k, (r, t) in enumerate(v)]
    rows = [(c, k, r or None, t or None, e) for c, k, r, t, e in rows]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int"), budget=128, history=32)
    got, said = {}, {}
    for r in made.select("*", chat.read_turns().alias("t"), chat.read_loss().alias("l")).orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).extend((x.role, x.text) for x in r.t)
        said.setdefault(r.conv_id, []).extend(r.l)
        assert len(r.t) == r.n_new
        held = [x.partition("<|text|>") for x in r.formatted.split("<|end|>")[:-1]]
        assert r.tokens == sum(len(x.encode().split()) + 4 for _, _, x in held)
        others = [x for head, _, x in held if not head.endswith("system")]
        assert r.tokens <= 128 or len(others) <= 1
        if turns[r.conv_id][0][0] == "system":
            assert r.formatted.startswith(("<|turn|>" if r.window == 0 else "<|again|>") + "system")
    assert got == turns
    assert said == {c: [t for r, t in v if r == "assistant"] for c, v in turns.items()} | {c: [] for c in said if not any(r == "assistant" for r, _ in turns[c])}
    assert max(r.n for r in made.groupBy("conv_id").agg(F.count("*").alias("n")).collect()) > 3


def test_warc(spark):
    rng = random.Random(7)
    big = "".join(rng.choice("abc é") for _ in range(60000))
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (7, "u", big), (8, "u", None), (9, "u", ""), (10, "bad\r\nurl", "x\r\n\r\n0\r\n\r\n"), (None, "n", "same"), (None, "m", "alone"), (7, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    back = warc.reassemble(warc.records(warc.write(df))).collect()
    assert len(back) == len(rows) and not [r.error for r in back if r.error]
    found = {r.record_id: r for r in back}
    assert bytes(found["<urn:pagelattice:record:7>"].payload).decode() == big
    assert {r.record_id: r.refers_to for r in back if r.type == "revisit"} == {f"<urn:pagelattice:record:{i}>": "<urn:pagelattice:record:5>" for i in (1, 3, None)} | {"<urn:pagelattice:record:8>": "<urn:pagelattice:record:9>"}
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() for r in back if r.payload is not None)
    assert {r.type for r in warc.reassemble(warc.records(warc.write(df, min_revisit=10))).collect()} == {"response", "revisit"} - {"revisit"}


def test_warc_faults(spark):
    parts = warc.records_of(4, "u", b"y" * 40000, None)
    assert len(parts) == 3
    shuffled, missing = b"".join(parts[::-1]), b"".join(parts[:2])
    df = spark.createDataFrame([(bytearray(shuffled),)], "data binary")
    assert [(r.payload_bytes, r.error) for r in warc.reassemble(warc.records(df)).collect()] == [(40000, None)]
    for data in (missing, b"".join(parts[1:]), b"".join([*parts, parts[1]])):
        (r,) = warc.reassemble(warc.records(spark.createDataFrame([(bytearray(data),)], "data binary"))).collect()
        assert r.payload is None and "WarcError" in r.error
    assert [r.type for r in warc.records(spark.createDataFrame([(bytearray(b"WARC/1.1\r\nContent-Length: 9"),), (None,)], "data binary")).collect()] == ["error"]
    broken = spark.createDataFrame([(bytearray(shuffled + b"WARC/1.1\r\nContent-Length: 9"),)], "data binary")
    assert sorted((r.type, r.payload_bytes, r.error is None) for r in warc.reassemble(warc.records(broken)).collect()) == [("error", None, False), ("response", 40000, True)]
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(40, 16)) * s for c, s in zip(centers, np.linspace(0.05, 0.6, 12), strict=True)]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(900, x[0].tolist(), 2), (901, (x[0] * 2).tolist(), 2), (902, None, 1), (903, [0.0] * 16, 1), (904, [float("nan")] * 16, 1), (905, [None] + [1.0] * 15, 1), (906, [], 1), (907, [1.0, 2.0], 1), (908, [1.0, 2.01], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    find, join = union(0)
    links = dict.fromkeys([i for i, _, _ in rows if i is not None], 0)
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.9:
                links[i] += 1
                join(i, j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (links[i], find(i), find(i) == i) for i in links}


def test_vector_blocks_agree_with_brute_force():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 20)) + 1, rng.normal(size=(90, 20)) + 1
    _, basis = np.linalg.eigh(a.T @ a)
    for same, y in ((False, b), (True, a)):
        i, j = vectors.compare(a, y, basis[:, ::-1], 0.7, same)
        u, v = vectors._unit(a), vectors._unit(y)
        want = np.argwhere(u @ v.T >= 0.7)
        want = {tuple(w) for w in want if not same or w[0] < w[1]}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_pipeline_stages(spark, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs(spark, [x for x in corpus if x[0] is not None], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0, int(k == 5)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = p.run(spark, str(tmp_path))
    assert out.where("not intact").count() == 0 and out.count() > 0
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in p.STAGES[:-1]:
        now = common.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == columns, name
    kept = {r.doc_id for r in now.select("doc_id").distinct().collect()}
    assert not kept & {75, 76, 81} and kept <= {i for i, _ in corpus}


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ctw.score(none, F.lit(True)).count() == 0
    assert ctw.score(docs(spark, [(1, "a few words"), (None, None)]), F.lit(True)).count() == 2
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert tiff.documents(none).count() == 0 and chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.reassemble(warc.records(warc.write(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert substring.dedup(none, length_col="n_chars").columns == none.columns


def test_registered_queries():
    from pagelattice.llm.queries import QUERIES, SQL

    assert [q.split("_")[0] for q in QUERIES] == [f"op{k}" for k in range(1, 11)] and set(SQL) <= set(QUERIES)


def test_near_duplicates_of_large_varied_groups_are_all_found(spark):
    rng = random.Random(31)
    texts = []
    for g in range(3):
        base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(110)]
        for k in range(250):
            w = list(base)
            for at in rng.sample(range(110), rng.randint(2, 4)):
                w[at] = f"edit{rng.random()}"
            texts.append((g * 1000 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_near_blocks_of_a_large_varied_group_are_all_found(spark):
    rng = random.Random(33)
    base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(110)]
    texts = []
    for k in range(250):
        w = list(base)
        for at in rng.sample(range(110), rng.randint(2, 4)):
            w[at] = f"edit{rng.random()}"
        texts.append((k, " ".join(w)))
    df = docs(spark, texts).select("doc_id", "text")
    rows = substring._near_blocks(df, substring._parts(substring._told_apart(df, [])).select("doc_id", "version", F.inline("blocks")), []).collect()
    want = {i: c for i, (_, c, _) in brute_groups(texts).items()}
    many = {i: c for i, c in want.items() if sum(x == c for x in want.values()) > 1}
    assert {r.doc_id: r.first_doc for r in rows} == many
