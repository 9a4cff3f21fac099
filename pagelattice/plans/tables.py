"""Queries over table grids made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box
from pagelattice.operators import tables
from pagelattice.sources.bridge import dealt, duckdb, view

_KEY = ["table_id"]
# A table per order that has lines: 3 x 3 cells of 80 x 30 points at (10, 20); line numbers pick cells.
GRID_TABLES = "SELECT DISTINCT l_orderkey AS table_id, 3 AS row_count, 3 AS column_count, CAST(10 AS DOUBLE) AS \"left\", CAST(20 AS DOUBLE) AS top, CAST(250 AS DOUBLE) AS \"right\", CAST(110 AS DOUBLE) AS bottom, CAST(0.9 AS DOUBLE) AS confidence FROM lineitem"
GRID_CELLS = """SELECT l_orderkey AS table_id, l_partkey AS cell, CAST((l_linenumber - 1) % 3 AS INT) AS row_index, CAST(l_partkey % 3 AS INT) AS column_index,
  CAST(CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS row_span, CAST(CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 1 END AS INT) AS column_span,
  CAST(10 + 80 * (l_partkey % 3) + l_suppkey % 4 AS DOUBLE) AS "left", CAST(20 + 30 * ((l_linenumber - 1) % 3) + l_partkey % 5 AS DOUBLE) AS top,
  CAST(10 + 80 * (l_partkey % 3) + 80 * CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 1 END - l_partkey % 2 AS DOUBLE) AS "right", CAST(20 + 30 * ((l_linenumber - 1) % 3) + 30 * CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS bottom,
  l_returnflag = 'R' AS synthetic, l_linestatus = 'O' AS has_content, CASE WHEN l_partkey % 6 = 0 THEN l_discount * 10 END AS merge_confidence FROM lineitem"""


def _table(spark, sf_dir, text, key=None):
    """Rows made of lines by SQL; lines are dealt by a key, if one is given, over partitions in proportion to them."""
    lines = view(spark, sf_dir, "lineitem")
    if key:
        lines = dealt(spark, sf_dir, lines, key)
    return spark.sql(text.replace('"', "`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)


def _inputs(spark, sf_dir, key=None):
    return _table(spark, sf_dir, GRID_TABLES, key), _table(spark, sf_dir, GRID_CELLS, key)


_WITH = f"WITH tb AS ({GRID_TABLES}), c AS ({GRID_CELLS})"
_POS = """, ok AS (SELECT c.*, row_index + row_span <= 3 AND column_index + column_span <= 3 AS fits FROM c),
pos AS (SELECT table_id, cell, row, unnest(generate_series(column_index, column_index + column_span - 1)) AS col FROM (SELECT *, unnest(generate_series(row_index, row_index + row_span - 1)) AS row FROM ok WHERE fits)),
grid AS (SELECT table_id, row, unnest(generate_series(0, 2)) AS col FROM (SELECT table_id, unnest(generate_series(0, 2)) AS row FROM tb)),
owned AS (SELECT table_id, row, col, count(*) AS n FROM pos GROUP BY ALL)"""


def grid_boundaries(spark, sf_dir):
    t, c = _inputs(spark, sf_dir, "l_orderkey")
    rows = tables.boundaries(c, t, _KEY, "row_index", "row_span", "top", "bottom", "row_count", ("top", "bottom"))
    cols = tables.boundaries(c, t, _KEY, "column_index", "column_span", "left", "right", "column_count", ("left", "right"))
    return rows.withColumn("axis", F.lit("row")).unionByName(cols.withColumn("axis", F.lit("column"))).select("table_id", "axis", F.col("k").cast("int").alias("k"), "position", "confidence", "uniform")


def _axis(name, index, span, low, high):
    return f"""v{name} AS (SELECT table_id, {index} AS k, "{low}" AS v FROM c WHERE {index} + {span} <= 3 UNION ALL SELECT table_id, {index} + {span}, "{high}" FROM c WHERE {index} + {span} <= 3 UNION ALL SELECT table_id, 0, "{low}" FROM tb UNION ALL SELECT table_id, 3, "{high}" FROM tb),
k{name} AS (SELECT table_id, k, median(v) AS m, max(v) - min(v) AS spread FROM v{name} GROUP BY ALL),
e{name} AS (SELECT * FROM (SELECT table_id, "{low}" AS lo, "{high}" AS hi, unnest(generate_series(0, 3)) AS k FROM tb)),
f{name} AS (SELECT e.table_id, e.k, lo, hi, CASE e.k WHEN 0 THEN lo WHEN 3 THEN hi ELSE m END AS m, CASE WHEN e.k IN (0, 3) THEN CAST(0.95 AS DOUBLE) WHEN m IS NOT NULL THEN CASE WHEN spread <= 3 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END END AS c FROM e{name} e LEFT JOIN k{name} k ON e.table_id = k.table_id AND e.k = k.k),
g{name} AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN {{'k': k, 'm': m}} END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN m IS NOT NULL THEN {{'k': k, 'm': m}} END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM f{name}),
h{name} AS (SELECT *, coalesce(m, a.m + (z.m - a.m) / greatest(z.k - a.k, 1) * (k - a.k)) AS p FROM g{name}),
i{name} AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY table_id ORDER BY k) >= CAST(0.5 AS DOUBLE), k = 0) AS ok FROM h{name}),
j{name} AS (SELECT *, NOT bool_and(ok) OVER (PARTITION BY table_id) AS uniform FROM i{name})"""


_SELECT_AXIS = "SELECT table_id, '{0}' AS axis, CAST(k AS INT) AS k, CASE WHEN uniform THEN lo + (hi - lo) / 3 * k ELSE p END AS position, CASE WHEN uniform THEN CAST(0.4 AS DOUBLE) ELSE coalesce(c, CAST(0.6 AS DOUBLE)) END AS confidence, uniform FROM j{0}"
GRID_BOUNDARIES = _WITH + ", " + _axis("row", "row_index", "row_span", "top", "bottom") + ", " + _axis("column", "column_index", "column_span", "left", "right") + " " + _SELECT_AXIS.format("row") + " UNION ALL " + _SELECT_AXIS.format("column")


def grid_missing(spark, sf_dir):
    t, c = _inputs(spark, sf_dir, "l_orderkey")
    return tables.missing(t, c.where("row_index + row_span <= 3 and column_index + column_span <= 3"), _KEY).select("table_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


GRID_MISSING = _WITH + _POS + " SELECT table_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM grid ANTI JOIN owned USING (table_id, row, col)"


def grid_ownership_issues(spark, sf_dir):
    t, c = _inputs(spark, sf_dir, "l_orderkey")
    return tables.ownership(t, c, _KEY).select("table_id", "code", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


_OWN = _WITH + _POS + """, iss AS (SELECT table_id, 'DUPLICATE_CELL_ANCHOR' AS code, row_index AS row, column_index AS col FROM c GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT table_id, 'CELL_SPAN_OUTSIDE_GRID', row_index, column_index FROM ok WHERE NOT fits UNION ALL SELECT table_id, 'UNCOVERED_GRID_POSITION', row, col FROM grid ANTI JOIN owned USING (table_id, row, col)
UNION ALL SELECT table_id, 'OVERLAPPING_GRID_OWNERSHIP', row, col FROM owned WHERE n > 1)"""
GRID_OWNERSHIP_ISSUES = _OWN + " SELECT table_id, code, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM iss"


def table_normalized(spark, sf_dir):
    t, c = _inputs(spark, sf_dir)
    return tables.normalized(t, c, _KEY)


TABLE_NORMALIZED = _WITH + _POS + """, n AS (SELECT table_id, count(*) AS source, count_if(fits) AS mapped, count(DISTINCT CASE WHEN fits THEN row_index END) AS rows, count(DISTINCT CASE WHEN fits THEN column_index END) AS cols FROM ok GROUP BY table_id),
a AS (SELECT table_id, count(*) AS covered FROM owned GROUP BY table_id),
x AS (SELECT tb.table_id, coalesce(covered, 0) AS covered, CAST(mapped AS BIGINT) AS mapped, source, CAST(0.1 AS DOUBLE) + least(coalesce(covered, 0) / CAST(9 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.4 AS DOUBLE) + least(mapped / CAST(greatest(source, 1) AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.2 AS DOUBLE)
  + least(rows / CAST(3 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.15 AS DOUBLE) + least(cols / CAST(3 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.15 AS DOUBLE) AS confidence FROM tb LEFT JOIN n USING (table_id) LEFT JOIN a USING (table_id))
SELECT table_id, covered, mapped, confidence, CASE WHEN covered = 9 AND source > 0 AND confidence >= CAST(0.55 AS DOUBLE) THEN 'editable' ELSE 'visual_fallback' END AS disposition FROM x"""


def table_validation(spark, sf_dir):
    t, c = _inputs(spark, sf_dir)
    t = t.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top"), "rotation": F.expr("CASE WHEN table_id % 13 = 0 THEN 90D WHEN table_id % 17 = 0 THEN -1D END"), "has_nested_tables": F.col("table_id") % 19 == 0})
    rows, columns, borders = (_table(spark, sf_dir, x) for x in (ROW_SEGMENTS, COLUMN_SEGMENTS, BORDERS))
    return tables.validated(t, c, rows, columns, borders, _KEY)


_ORDERED = "SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem l"
# Three rows of 30 and three columns of 80 points, which lines of an order bend, shorten or leave out.
ROW_SEGMENTS = f"SELECT l_orderkey AS table_id, CAST(n AS INT) AS k, CAST(20 + 30 * n + CASE WHEN l_partkey % 50 = 0 THEN 4 ELSE 0 END AS DOUBLE) AS start, CAST(50 + 30 * n - CASE WHEN l_suppkey % 40 = 0 THEN 33 ELSE 0 END AS DOUBLE) AS \"end\" FROM ({_ORDERED}) x WHERE n < 3 AND l_partkey % 30 <> 1 UNION ALL SELECT DISTINCT l_orderkey, 2, CAST(80 AS DOUBLE), CAST(110 AS DOUBLE) FROM lineitem WHERE l_orderkey % 5 < 4"
COLUMN_SEGMENTS = f"SELECT l_orderkey AS table_id, CAST(n AS INT) AS k, CAST(10 + 80 * n AS DOUBLE) AS start, CAST(CASE WHEN l_partkey % 23 = 0 THEN 15 WHEN l_partkey % 29 = 0 THEN 95 ELSE 90 END + 80 * n AS DOUBLE) AS \"end\" FROM ({_ORDERED}) x WHERE n < 3"
BORDERS = "SELECT l_orderkey AS table_id, CASE l_partkey % 31 WHEN 0 THEN 'wavy' WHEN 1 THEN NULL WHEN 2 THEN 'none' WHEN 3 THEN 'dashed' ELSE 'single' END AS style, CAST(CASE WHEN l_suppkey % 37 = 0 THEN -1 ELSE 0.5 END AS DOUBLE) AS width FROM lineitem"


def _axis(p: str, segments: str, low: str, high: str, narrow: bool) -> str:
    """CTEs of the issues ({p}i) and the score ({p}f) of an axis of three definitions."""
    thin = f" UNION ALL SELECT table_id, 'error' FROM (SELECT *, sum(w) OVER (PARTITION BY table_id) AS total FROM (SELECT *, greatest(z - a, CAST(0 AS DOUBLE)) AS w FROM {p}o)) WHERE total > 0 AND w * (least(total, 468) / total) < 6" if narrow else ""
    return f""", {p}s AS (SELECT table_id, k, start AS a, "end" AS z FROM ({segments})), {p}o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY a DESC, z DESC) AS r FROM {p}s) WHERE r = 1),
{p}g AS (SELECT *, lag(z) OVER (PARTITION BY table_id ORDER BY k) AS before FROM {p}o WHERE z > a),
{p}i AS (SELECT table_id, 'error' AS severity FROM (SELECT tb.table_id, count({p}s.k) AS n FROM tb LEFT JOIN {p}s USING (table_id) GROUP BY 1) WHERE n <> 3 UNION ALL SELECT table_id, 'error' FROM {p}s GROUP BY table_id, k HAVING count(*) > 1 UNION ALL SELECT table_id, 'error' FROM {p}o WHERE z <= a
  UNION ALL SELECT table_id, 'error' FROM {p}g WHERE a < {low} - 1.5 OR z > {high} + 1.5 UNION ALL SELECT table_id, 'error' FROM {p}g WHERE a < before - CAST(1.5 AS DOUBLE) UNION ALL SELECT table_id, 'warning' FROM {p}g WHERE abs(a - before) > CAST(1.5 AS DOUBLE){thin}),
{p}f AS (SELECT table_id, least(greatest(coalesce(ok, 0) / CAST(3 AS DOUBLE) - coalesce(e, 0) * CAST(0.12 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS score, coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM tb LEFT JOIN (SELECT table_id, count(DISTINCT k) AS ok FROM {p}s WHERE z > a GROUP BY 1) USING (table_id)
  LEFT JOIN (SELECT table_id, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w FROM {p}i GROUP BY 1) USING (table_id))"""


_CL = lambda x: f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"
_PART = lambda s, w: f"{s} * CAST({w} AS DOUBLE)"
_WEIGHTS = {"structure_score": 0.35, "geometry_score": 0.2, "content_score": 0.15, "merge_score": 0.1, "style_score": 0.1, "reconstruction_score": 0.1}
TABLE_VALIDATION = _OWN + _axis("r", ROW_SEGMENTS, "20", "110", False) + _axis("k", COLUMN_SEGMENTS, "10", "250", True) + f""", e AS (SELECT table_id, count(*) AS grid_errors, count_if(code = 'DUPLICATE_CELL_ANCHOR') AS dup, count_if(code = 'CELL_SPAN_OUTSIDE_GRID') AS outside, count_if(code IN ('UNCOVERED_GRID_POSITION', 'OVERLAPPING_GRID_OWNERSHIP')) AS not_once FROM iss GROUP BY table_id),
p AS (SELECT table_id, count(*) AS cells, count_if(row_span > 1 OR column_span > 1) AS merged, count_if((row_span > 1 OR column_span > 1) AND coalesce(merge_confidence < CAST(0.72 AS DOUBLE), false)) AS weak, count_if(synthetic AND has_content) AS filled, sum(CASE WHEN synthetic THEN row_span * column_span ELSE 0 END) AS made FROM c GROUP BY table_id),
b AS (SELECT table_id, count(*) AS edges, count_if(style IS NULL OR style = 'wavy' OR width < 0) AS bad FROM ({BORDERS}) GROUP BY table_id),
s AS (SELECT tb.table_id, coalesce(grid_errors, 0) AS grid_errors, weak, filled, confidence, rf.e + kf.e AS axis_errors, rf.w + kf.w AS gaps, bad, CASE WHEN tb.table_id % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN tb.table_id % 19 = 0 THEN 1 ELSE 0 END AS odd,
  least(made / CAST(9 AS DOUBLE), CAST(1 AS DOUBLE)) AS made, {_CL('(9 - coalesce(not_once, 0)) / CAST(9 AS DOUBLE) - coalesce(dup, 0) * CAST(0.1 AS DOUBLE) - coalesce(outside, 0) * CAST(0.1 AS DOUBLE)')} AS structure_score, (rf.score + kf.score) / 2 AS geometry_score,
  {_CL('(cells - filled) / CAST(greatest(cells, 1) AS DOUBLE) - filled * CAST(0.1 AS DOUBLE)')} AS content_score, CASE WHEN merged = 0 THEN CAST(1 AS DOUBLE) ELSE {_CL('(merged - weak) / CAST(greatest(merged, 1) AS DOUBLE)')} END AS merge_score, (edges - bad) / CAST(edges AS DOUBLE) AS style_score,
  {_CL('1 - least(made / CAST(9 AS DOUBLE), CAST(1 AS DOUBLE))')} AS reconstruction_score FROM tb LEFT JOIN e USING (table_id) LEFT JOIN p USING (table_id) LEFT JOIN rf USING (table_id) LEFT JOIN kf USING (table_id) LEFT JOIN b USING (table_id)),
d AS (SELECT *, ({' + '.join(_PART(k, w) for k, w in _WEIGHTS.items())}) * CAST(0.85 AS DOUBLE) + {_CL('confidence')} * CAST(0.15 AS DOUBLE) AS native_confidence,
  CAST(grid_errors + weak + filled + CASE WHEN made > CAST(0.35 AS DOUBLE) THEN 1 ELSE 0 END + axis_errors + bad + odd AS BIGINT) AS errors, CAST(CASE WHEN made > 0 AND made <= CAST(0.35 AS DOUBLE) THEN 1 ELSE 0 END + gaps AS BIGINT) AS warnings FROM s)
SELECT table_id, {', '.join(_WEIGHTS)}, native_confidence, errors, warnings, CASE WHEN errors > 0 OR native_confidence < CAST(0.65 AS DOUBLE) THEN 'visual_fallback' WHEN warnings > 0 THEN 'native_with_warnings' WHEN native_confidence >= CAST(0.8 AS DOUBLE) THEN 'native_safe' ELSE 'native_with_warnings' END AS decision FROM d"""


def merge_proposals(spark, sf_dir):
    """Spans that cells' extents ask for against an even grid."""
    _, c = _inputs(spark, sf_dir)
    edges = lambda a, step: F.array(*[F.lit(float(a + step * k)) for k in range(4)])
    rows, row_conf = tables.axis_span(F.col("top"), F.col("bottom"), F.col("row_index"), F.lit(1), edges(20, 30))
    cols, col_conf = tables.axis_span(F.col("left"), F.col("right"), F.col("column_index"), F.lit(1), edges(10, 80))
    return c.select("table_id", "cell", "row_index", "column_index", rows.cast("int").alias("want_rows"), cols.cast("int").alias("want_cols"), row_conf.alias("row_confidence"), col_conf.alias("column_confidence"))


def _want(start, end, index, origin, step):
    far = f"list_transform(generate_series({index} + 1, 3), lambda k: abs({end} - ({origin} + {step} * k)))"
    least, off = f"list_min({far})", f"abs({start} - ({origin} + {step} * {index}))"
    wide = f"list_position({far}, {least})"
    ok = f"coalesce({off} <= 4 AND {least} <= 4 AND {wide} > 1, false)"
    return f"CAST(CASE WHEN {ok} THEN {wide} ELSE 1 END AS INT)", f"CASE WHEN {ok} THEN greatest(CAST(0.75 AS DOUBLE), 1 - greatest({off}, {least}) / CAST(4 AS DOUBLE) * CAST(0.25 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"


_ROW, _COL = _want("top", "bottom", "row_index", "CAST(20 AS DOUBLE)", "CAST(30 AS DOUBLE)"), _want('"left"', '"right"', "column_index", "CAST(10 AS DOUBLE)", "CAST(80 AS DOUBLE)")
MERGE_PROPOSALS = _WITH + f" SELECT table_id, cell, row_index, column_index, {_ROW[0]} AS want_rows, {_COL[0]} AS want_cols, {_ROW[1]} AS row_confidence, {_COL[1]} AS column_confidence FROM c"


def accepted_merges(spark, sf_dir):
    """Merges taken greedily from the proposals (order-dependent; no SQL form)."""
    _, c = _inputs(spark, sf_dir)
    first = c.groupBy("table_id", "row_index", "column_index").agg(F.max("has_content").alias("has_content"), F.min("synthetic").alias("synthetic"), F.max("row_span").alias("want_rows"), F.max("column_span").alias("want_cols"))
    return tables.merges(first.withColumns({"geometry": F.lit(0.9), "borderless": F.lit(0.5)}), _KEY)


def cell_content(spark, sf_dir):
    """Boxes of a page that belong to its cells: every third box is a cell, the others are spans."""
    b = view(spark, sf_dir, "box")
    cell = b.where("box_id % 3 = 0").select("page_number", F.col("box_id").alias("cell"), (F.col("l") - 40).alias("cl"), (F.col("t") - 40).alias("ct"), (F.col("r") + 40).alias("cr"), (F.col("b") + 40).alias("cb"))
    span = b.where("box_id % 3 <> 0").select("page_number", F.col("box_id").alias("span"), "l", "t", "r", "b")
    pairs = tables.cell_spans(cell, span, ["page_number"], Box(cell["cl"], cell["ct"], cell["cr"], cell["cb"]), Box(span["l"], span["t"], span["r"], span["b"]))
    return pairs.select(cell["page_number"], "cell", "span", "cl", "l")


CELL_CONTENT = duckdb("box") + """, c AS (SELECT page_number, box_id AS cell, l - 40 AS cl, t - 40 AS ct, r + 40 AS cr, b + 40 AS cb FROM box WHERE box_id % 3 = 0), s AS (SELECT page_number, box_id AS span, l, t, r, b FROM box WHERE box_id % 3 <> 0)
SELECT c.page_number, cell, span, cl, l FROM c JOIN s ON c.page_number = s.page_number AND (((l + r) / 2 BETWEEN cl - CAST(1.5 AS DOUBLE) AND cr + CAST(1.5 AS DOUBLE) AND (t + b) / 2 BETWEEN ct - CAST(1.5 AS DOUBLE) AND cb + CAST(1.5 AS DOUBLE))
  OR greatest(least(r, cr) - greatest(l, cl), CAST(0 AS DOUBLE)) * greatest(least(b, cb) - greatest(t, ct), CAST(0 AS DOUBLE)) / greatest((r - l) * (b - t), CAST(1 AS DOUBLE)) >= CAST(0.55 AS DOUBLE))"""

def _segments(spark, sf_dir):
    t = _table(spark, sf_dir, GRID_TABLES, "l_orderkey")
    seg = "SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS INT) AS k, CAST(20 + 30 * (l_linenumber - 1) + l_partkey % 4 AS DOUBLE) AS start, CAST(20 + 30 * l_linenumber - l_suppkey % 33 AS DOUBLE) AS \"end\" FROM lineitem"
    return t, _table(spark, sf_dir, seg, "l_orderkey")


def row_issues(spark, sf_dir):
    t, s = _segments(spark, sf_dir)
    return tables.axis_issues(t, s, _KEY, "row_count", "top", "bottom")


_SEG = _WITH + """, s AS (SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS INT) AS k, CAST(20 + 30 * (l_linenumber - 1) + l_partkey % 4 AS DOUBLE) AS a, CAST(20 + 30 * l_linenumber - l_suppkey % 33 AS DOUBLE) AS z FROM lineitem),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY a DESC, z DESC) AS r FROM s WHERE k BETWEEN 0 AND 2) WHERE r = 1), g AS (SELECT *, lag(z) OVER (PARTITION BY table_id ORDER BY k) AS p FROM o WHERE z > a),
n AS (SELECT tb.table_id, count(s.k) AS n FROM tb LEFT JOIN s USING (table_id) GROUP BY tb.table_id),
ri AS (SELECT table_id, 'INCOMPLETE_DEFINITIONS' AS code, 'error' AS severity, CAST(NULL AS INT) AS k FROM n WHERE n <> 3 UNION ALL SELECT table_id, 'DUPLICATE_INDEX', 'error', k FROM s GROUP BY table_id, k HAVING count(*) > 1
UNION ALL SELECT table_id, 'NON_POSITIVE_EXTENT', 'error', k FROM o WHERE z <= a UNION ALL SELECT table_id, 'OUTSIDE_TABLE_BOUNDS', 'error', k FROM g WHERE a < CAST(18.5 AS DOUBLE) OR z > CAST(111.5 AS DOUBLE)
UNION ALL SELECT table_id, 'NON_MONOTONIC_GEOMETRY', 'error', k FROM g WHERE a < p - CAST(1.5 AS DOUBLE) UNION ALL SELECT table_id, 'BOUNDARY_GAP', 'warning', k FROM g WHERE abs(a - p) > CAST(1.5 AS DOUBLE))"""
ROW_ISSUES = _SEG + " SELECT * FROM ri"


def row_scores(spark, sf_dir):
    t, s = _segments(spark, sf_dir)
    return tables.axis_score(tables.axis_issues(t, s, _KEY, "row_count", "top", "bottom"), t, s, _KEY, "row_count")


ROW_SCORES = _SEG + """, u AS (SELECT table_id, count(DISTINCT k) AS ok FROM s WHERE k BETWEEN 0 AND 2 AND z > a GROUP BY table_id), e AS (SELECT table_id, count(*) AS e FROM ri WHERE severity = 'error' GROUP BY table_id)
SELECT table_id, least(greatest(coalesce(ok, 0) / CAST(3 AS DOUBLE) - coalesce(e, 0) * CAST(0.12 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS score FROM tb LEFT JOIN u USING (table_id) LEFT JOIN e USING (table_id)"""

QUERIES = {
    "grid_boundaries": grid_boundaries, "grid_missing": grid_missing, "grid_ownership_issues": grid_ownership_issues, "table_normalized": table_normalized, "table_validation": table_validation,
    "merge_proposals": merge_proposals, "accepted_merges": accepted_merges, "cell_content": cell_content, "row_issues": row_issues, "row_scores": row_scores}
SQL = {
    "grid_boundaries": GRID_BOUNDARIES, "grid_missing": GRID_MISSING, "grid_ownership_issues": GRID_OWNERSHIP_ISSUES, "table_normalized": TABLE_NORMALIZED, "table_validation": TABLE_VALIDATION,
    "merge_proposals": MERGE_PROPOSALS, "cell_content": CELL_CONTENT, "row_issues": ROW_ISSUES, "row_scores": ROW_SCORES}
