"""Queries whose tasks hold no more when the input grows, and documents that get no file."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import tables
from pagelattice.plans import documents
from pagelattice.plans.queries import QUERIES
from pagelattice.sources import bridge

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@given
@pytest.mark.parametrize("name", ["reconstructed_tables", "reconstructed_cells", "snapped_cells", "grid_ownership_issues", "row_issues", "render_actions", "list_marker_styles"])
def test_partitions_grow_with_rows(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "ROWS", 500)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= math.ceil(rows / 500)


@given
def test_sections_of_documents_with_items_alone(spark):
    docs = spark.createDataFrame([(3,), (7,), (11,)], "doc_id long")
    every, some = documents._sectioned(spark, DATA), documents._sectioned(spark, DATA, docs)
    for whole, part in zip(every, some, strict=True):
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.where("doc_id in (3, 7, 11)").collect()))


def test_ownership_of_odd_tables(spark):
    t = spark.createDataFrame([(1, 2, 2), (2, 0, 3), (3, 2, 3), (5, None, 2)], "t int, row_count int, column_count int")
    c = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 0, 0, 2, 1), (1, 1, 1, 1, 2), (3, None, 0, 1, 1), (3, None, 0, 1, 1), (4, 0, 0, 1, 1), (4, 0, 0, 1, 1)], "t int, row_index int, column_index int, row_span int, column_span int")
    got = sorted(map(tuple, tables.ownership(t, c, ["t"]).collect()), key=str)
    gap = "UNCOVERED_GRID_POSITION"
    want = [(1, "DUPLICATE_CELL_ANCHOR", 0, 0), (1, "OVERLAPPING_GRID_OWNERSHIP", 0, 0), (1, "CELL_SPAN_OUTSIDE_GRID", 1, 1), (1, gap, 0, 1), (1, gap, 1, 1), (3, "DUPLICATE_CELL_ANCHOR", None, 0), (4, "DUPLICATE_CELL_ANCHOR", 0, 0)]
    assert got == sorted(want + [(3, gap, r, k) for r in range(2) for k in range(3)], key=str)
    # a cell that reaches out of the grid covers what of it is inside
    assert sorted(map(tuple, tables.missing(t.where("t = 1"), c, ["t"]).collect())) == [(1, 0, 1)]


def test_boundaries_of_an_axis(spark):
    t = spark.createDataFrame([(1, 4, 0.0, 40.0), (2, 2, None, 9.0), (3, 0, 1.0, 2.0), (4, 2, 0.0, 0.5)], "t int, n int, lo double, hi double")
    c = spark.createDataFrame([(1, 0, 1, 1.0, 9.0), (1, 1, 1, 14.0, 20.0), (1, 0, 1, 0.0, None), (1, 1, 9, 7.0, 7.0)], "t int, i int, s int, a double, z double")
    got = sorted(map(tuple, tables.boundaries(c, t, ["t"], "i", "s", "a", "z", "n", ("lo", "hi")).collect()))
    one = [(1, 0, 0.0, 0.95, False), (1, 1, 11.5, 0.7, False), (1, 2, 20.0, 0.95, False), (1, 3, 30.0, 0.6, False), (1, 4, 40.0, 0.95, False)]
    assert got == one + [(2, k, None, 0.4, True) for k in range(3)] + [(3, 0, 1.0, 0.95, False)] + [(4, 0, 0.0, 0.4, True), (4, 1, 0.25, 0.4, True), (4, 2, 0.5, 0.4, True)]


def test_suppressed_by_id(spark):
    from pagelattice.operators import render

    rows = [(1, 5, "table", "body", "editable", 0.0, 0.0, 9.0, 9.0), (1, 2, "image", "body", "visual", 0.0, 0.0, 9.0, 9.0), (1, 7, "paragraph", "body", "editable", 1.0, 1.0, 2.0, 2.0), (1, 7, "paragraph", "header", "editable", 1.0, 1.0, 2.0, 2.0),
            (None, 8, "image", "body", "visual", 0.0, 0.0, 9.0, 9.0), (None, 9, "paragraph", "body", "editable", 1.0, 1.0, 2.0, 2.0)]
    items = spark.createDataFrame(rows, "page int, id int, kind string, role string, disposition string, left double, top double, right double, bottom double")
    got = render.suppress(items, ["page"], "id")
    assert sorted((r.id, r.role, r.covered_by, r.disposition) for r in got.where(F.col("kind") == "paragraph").collect()) == [(7, "body", 2, "skip"), (7, "header", 2, "skip"), (9, "body", None, "editable")]


@given
def test_files_read_lines_once_in_tasks_that_grow(spark, monkeypatch):
    docs = spark.createDataFrame([(3,), (7,), (11,)], "doc_id long")
    assert not [f for df in documents._sectioned(spark, DATA, docs) for f in df.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]
    monkeypatch.setattr(bridge, "ROWS", 4_000)  # 13 documents a task
    rows = spark.read.parquet(f"{DATA}/documents.parquet").count()
    contents = documents.docx_contents(spark, DATA)
    assert contents.rdd.getNumPartitions() >= rows // 14
    read = [Path(f).name for f in contents.inputFiles()]
    assert not {"lineitem.parquet", "orders.parquet"} & set(read)
    assert contents.count() == rows


def test_stored_where_no_folder_is_shared(spark, monkeypatch):
    df = spark.range(3)
    got = bridge.stored(df)
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == [0, 1, 2] and got.inputFiles()
    context = df.sparkSession.sparkContext
    monkeypatch.setattr(context, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(context, "getConf", dict)
    monkeypatch.setattr(context, "master", "spark://host:7077")
    assert bridge.stored(df).inputFiles() == []
