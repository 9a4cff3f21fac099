"""Every layout query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pagelattice.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    if name not in SQL:
        return
    rel = views.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == _sorted(tuple(r[k] for k in at) for r in rel.fetchall())
