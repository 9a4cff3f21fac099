"""What a task's worker holds at a time stays small."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from pagelattice.llm import ctw, neardup


def test_language_model_block(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(ctw, "map_arrow", lambda df, run, schema: taken.append(run))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    ctw._blocks(spark.createDataFrame([], "id long, text string, learn boolean"), "id", "text")
    letters = np.random.default_rng(1).choice(np.frombuffer(b"abcdefghijklmnopqrst    ", np.uint8), (512, 8192))
    texts = [row.tobytes().decode() for row in letters]
    batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(texts), pa.array([k % 2 == 0 for k in range(512)])], names=["id", "text", "learn"])
    size, asked, largest = sum(map(len, texts)), 0, 0
    tracemalloc.start()
    for b in taken[0](iter([batch])):
        largest = max(largest, b.nbytes)
        asked += sum(len(x.as_py()) // 4 for k, x in zip(b.column(1).to_pylist(), b.column(5)) if k == 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = np.concatenate([code for _, code in ctw.Strings([ctw.stream(t.encode().split()) for t in texts]).slices()])
    assert asked == len(np.unique(strings)) > size / 2
    print(peak / size, largest / size)
    assert peak < 40 * size and largest < 3 * size


def test_lots():
    for sizes in ([], [1], [ctw.LOT + 1, 1, 2], [ctw.LOT - 1, 1, 1], [1, ctw.LOT, 1]):
        lots = list(ctw._lots(sizes))
        assert [k for s, e in lots for k in range(s, e)] == list(range(len(sizes)))
        assert all(e - s == 1 or sum(sizes[s:e]) <= ctw.LOT for s, e in lots)


def test_sets_are_compared_without_workers(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, 40, np.uint64)) for _ in range(3)]
    sets += [np.union1d(sets[0], sets[1][:k]) for k in (5, 13, 14)] + [np.zeros(0, np.uint64), sets[2][:1]]
    rows = [(k, [int(x) for x in s.view(np.int64)]) for k, s in enumerate(sets)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    got = neardup.compared(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "node long, set array<bigint>"))
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        both, either = len(np.intersect1d(sets[r.a], sets[r.b])), len(np.union1d(sets[r.a], sets[r.b]))
        assert r.similar == (both > 0 and 100 * both >= 75 * either) and abs(r.part - both / max(either, 1)) < 1e-12
    assert [x.as_py() for x in neardup.set_lists(sets)] == [s for _, s in rows]
    assert got.where("similar").count() > 2
