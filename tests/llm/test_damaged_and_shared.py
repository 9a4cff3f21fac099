"""Damaged files, ids that several texts share, small batches, and sessions that stay as they are."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import common, neardup, substring, tiff


def sentences(rng, n):
    words = ["w%d" % rng.randrange(10**6) for _ in range(n)]
    return " ".join(w + "." if k % 9 == 8 else w for k, w in enumerate(words))


def test_no_file_crashes_the_reader(spark):
    rng = random.Random(6)
    pixels = np.random.default_rng(1).integers(0, 9, (40, 50)).astype(np.uint8)
    whole = [tiff.write_tiff([pixels, pixels], scheme, 2, 7, tile) for scheme in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for tile in (None, (16, 16))]
    blobs = []
    for blob in whole:
        blobs += [blob[: rng.randrange(len(blob))] for _ in range(12)]
        for _ in range(60):
            bad = bytearray(blob)
            for _ in range(rng.randint(1, 4)):
                bad[rng.randrange(len(bad))] = rng.choice([0, 255, rng.randrange(256)])
            blobs.append(bytes(bad))
        (at,) = struct.unpack_from("<I", blob, 4)
        (count,) = struct.unpack_from("<H", blob, at)
        for k in range(count):  # each tag of the first page with each odd value and type
            for value in (0, 1, 2**31, 2**32 - 1):
                for kind in (None, 2, 12):
                    bad = bytearray(blob)
                    struct.pack_into("<I", bad, at + 2 + 12 * k + 8, value)
                    if kind:
                        struct.pack_into("<H", bad, at + 2 + 12 * k + 2, kind)
                    blobs.append(bytes(bad))
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)] + [(-1, bytearray(whole[0]))], "id int, media binary")
    got = tiff.pages(df).groupBy("id").agg(F.count("*").alias("n"), F.max("page").alias("last")).collect()
    assert {r.id for r in got} == set(range(-1, len(blobs))) and [r.last for r in got if r.id == -1] == [1]


def test_sizes_that_no_bytes_hold_are_refused():
    blob = tiff.write_tiff([np.zeros((4, 4), np.uint8)])
    (at,) = struct.unpack_from("<I", blob, 4)
    for tag, value in ((256, 10**9), (257, 10**9), (256, 0), (278, 0)):
        bad = bytearray(blob)
        for k in range(struct.unpack_from("<H", blob, at)[0]):
            if struct.unpack_from("<H", blob, at + 2 + 12 * k)[0] == tag:
                struct.pack_into("<I", bad, at + 2 + 12 * k + 8, value)
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(bytes(bad)))


def test_floating_point_predictor():
    """Rows stored as differences of bytes of equal weight, written here by hand."""
    a = np.random.default_rng(3).normal(size=(5, 7)).astype(np.float32)
    planes = a.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    blob = bytearray(b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw)
    tags = [(256, 4, 7), (257, 4, 5), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 5), (279, 4, len(raw)), (317, 3, 3), (339, 3, 3)]
    blob += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    ((page, _, _),) = tiff.read_pages(bytes(blob))
    assert (page[:, :, 0] == a).all()


def test_page_columns_do_not_clash(spark):
    with pytest.raises(ValueError):
        tiff.pages(spark.createDataFrame([(1, bytearray(b""))], "page int, media binary"), "page")


def test_rows_that_share_an_id_lose_only_what_they_repeat(spark):
    rng = random.Random(9)
    shared, own, other = sentences(rng, 81), sentences(rng, 207), sentences(rng, 60)
    rows = [(1, shared + "\n" + other), (2, sentences(rng, 60) + "\n" + shared), (2, own), (2, own), (3, own + "\n" + shared), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"version": F.lit("x"), "n_chars": F.length("text").cast("long")})
    got = [(r.doc_id, r.text, r.n_chars) for r in substring.dedup(df, length_col="n_chars").collect()]
    texts = sorted(t for i, t, _ in got if i == 2)
    assert len(got) == 6 and (1, rows[0][1], len(rows[0][1])) in got and (None, shared, len(shared)) in got
    assert texts.count(own) == 2
    (cut,) = [t for t in texts if t != own]
    assert len(cut.split()) < 90 and rows[1][1].startswith(cut[:200]) and all(n == len(t) for _, t, n in got)
    (third,) = [t for i, t, _ in got if i == 3]
    assert len(third.split()) < 60
    places = substring.passages(df).where("doc_id = 2").collect()
    assert all(r.version != 0 for r in places) and len({r.version for r in places}) == 2


def test_links_survive_small_batches(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "x"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(name), []
    try:
        for size in ("10000", "3"):
            spark.conf.set(name, size)
            found.append(sorted((r.doc_id, r.component_id) for r in neardup.groups(df).collect()))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]


def test_operators_leave_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    tiff.documents(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()
    assert spark.conf.get(name) == before


def test_functions_get_batches_of_a_bounded_size(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    got = [r.n for r in common.map_arrow(df, sizes, "n long").collect()]
    assert len(got) > 4 and max(got) < 2 * common.BATCH
