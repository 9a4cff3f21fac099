"""Ruled tables: tasks that hold no more when the input grows, and lines with gaps."""

import math
import random
from pathlib import Path

import pytest

from pagelattice.operators import ruling
from pagelattice.plans.queries import QUERIES
from pagelattice.sources import bridge

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
RULED = ["ruling_corners", "ruled_cells", "ruled_tables"]


@given
@pytest.mark.parametrize("name", RULED)
def test_partitions_grow_with_rows(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "ROWS", 500)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= math.ceil(rows / 500)


def _points(spark, rows):
    return spark.createDataFrame(rows, "page int, h long, v long, x double, y double")


def test_two_segments_at_one_place_are_no_side(spark):
    """Two pieces of an upright line, too far apart to be one, both meet a line between them."""
    shapes = [(1, True, 0.0, 0.0, 60.0), (1, True, 50.0, 0.0, 60.0), (1, True, 100.0, 0.0, 60.0), (1, False, 0.0, 0.0, 48.0), (1, False, 0.0, 52.0, 100.0), (1, False, 60.0, 0.0, 48.0), (1, False, 60.0, 52.0, 100.0)]
    lines = spark.createDataFrame(shapes, "page int, horizontal boolean, at double, start double, end double")
    points = ruling.corners(ruling.rulings(lines, ["page"]), ["page"])
    assert sorted((r.x, r.y) for r in points.collect()) == [(x, y) for x in (0.0, 60.0) for y in (0.0, 50.0, 50.0, 100.0)]
    assert sorted(map(tuple, ruling.cells(points, ["page"]).collect())) == [(1, 0.0, 0.0, 60.0, 50.0), (1, 0.0, 50.0, 60.0, 100.0)]


def test_cells_of_random_corners(spark):
    """Corners with holes, so that most next ones don't close, against all pairs of lines right and below; none of no page."""
    rng = random.Random(3)
    rows = [(page, h, v, 10.0 * (v // 2), 10.0 * (h // 2)) for page in (*range(12), None) for h in range(8) for v in range(8) if rng.random() < 0.5]
    want = {}
    for page, h, v, x, y in rows:
        for p, h2, v2, right, bottom in rows:
            if page is not None and p == page and right > x and bottom > y and (page, h, v2, right, y) in rows and (page, h2, v, x, bottom) in rows:
                want[page, x, y] = min(want.get((page, x, y), (bottom, right)), (bottom, right))
    got = {(r.page, r.left, r.top): (r.bottom, r.right) for r in ruling.cells(_points(spark, rows), ["page"]).collect()}
    assert got == want and len(got) > 80
