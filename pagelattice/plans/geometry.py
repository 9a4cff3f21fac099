"""Queries over the box view: box algebra, pair predicates, union area and page coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.functions.geometry import Box
from pagelattice.operators.coverage import merged_length, union_area
from pagelattice.sources.bridge import PAGE_HEIGHT, PAGE_WIDTH, dealt, duckdb, view

LTRB = "ltrb"


def page_box() -> Box:
    return Box(*(F.lit(x) for x in (0.0, 0.0, PAGE_WIDTH, PAGE_HEIGHT)))


def box_normalized(spark, sf_dir):
    """Edges in order; boxes that are flat, null or unordered by arithmetic on the id."""
    b = view(spark, sf_dir, "box").selectExpr(
        "page_number", "box_id", "CASE WHEN box_id = 2 THEN r WHEN box_id = 3 THEN NULL ELSE l END AS l", "t",
        "CASE WHEN box_id = 2 THEN l ELSE r END AS r", "CASE WHEN box_id = 4 THEN t ELSE b END AS b")
    n, o = G.normalized(Box.of(names=LTRB)), G.ordered(Box.of(names=LTRB))
    return b.select("page_number", "box_id", *(c.alias(f"n_{x}") for c, x in zip(n, LTRB, strict=True)), o.top.alias("o_t"), o.bottom.alias("o_b"), G.area(Box.of(names=LTRB)).alias("area"))


BOX_NORMALIZED = duckdb("box") + """, x AS (SELECT page_number, box_id, CASE WHEN box_id = 2 THEN r WHEN box_id = 3 THEN NULL ELSE l END AS l, t,
  CASE WHEN box_id = 2 THEN l ELSE r END AS r, CASE WHEN box_id = 4 THEN t ELSE b END AS b FROM box),
y AS (SELECT *, coalesce(l IS NOT NULL AND l <> r AND t <> b, false) AS ok FROM x)
SELECT page_number, box_id, CASE WHEN ok THEN least(l, r) END AS n_l, CASE WHEN ok THEN least(t, b) END AS n_t,
  CASE WHEN ok THEN greatest(l, r) END AS n_r, CASE WHEN ok THEN greatest(t, b) END AS n_b, least(t, b) AS o_t, greatest(t, b) AS o_b,
  CASE WHEN ok THEN abs(r - l) * abs(b - t) ELSE CAST(0 AS DOUBLE) END AS area FROM y"""


def _pairs(spark, sf_dir):
    b = view(spark, sf_dir, "box")
    x, y = (b.select("page_number", *(F.col(c).alias(f"{c}{s}") for c in ("box_id", *LTRB))) for s in "12")
    return x.join(y, "page_number").where("box_id1 < box_id2"), Box.of(suffix="1", names=LTRB), Box.of(suffix="2", names=LTRB)


def box_pairs(spark, sf_dir):
    p, a, b = _pairs(spark, sf_dir)
    i = G.intersection(a, b)
    return p.select(
        "page_number", "box_id1", "box_id2", *(c.alias(f"i_{x}") for c, x in zip(i, LTRB, strict=True)),
        G.intersection_area(a, b).alias("i_area"), G.touches(a, b).alias("touches"), G.strongly_overlaps(a, b).alias("strong"),
        G.near(a, b, 12).alias("near12"), G.near(a, b, 24).alias("near24"), G.near(a, b, 55).alias("near55"), G.distance(a, b).alias("distance"),
        G.gap_x(a, b).alias("gap_x"), G.vertical_overlap_ratio(a, b).alias("v_overlap"), G.coverage_of(a, b).alias("covered"), G.contains_center(b, a, 1.5).alias("centered"))


_PAIRS = duckdb("box") + """, p AS (SELECT x.page_number, x.box_id AS box_id1, y.box_id AS box_id2, x.l AS l1, x.t AS t1, x.r AS r1, x.b AS b1, y.l AS l2, y.t AS t2, y.r AS r2, y.b AS b2
  FROM box x JOIN box y ON x.page_number = y.page_number AND x.box_id < y.box_id),
q AS (SELECT *, greatest(least(r1, r2) - greatest(l1, l2), CAST(0 AS DOUBLE)) AS ox, greatest(least(b1, b2) - greatest(t1, t2), CAST(0 AS DOUBLE)) AS oy,
  greatest(l2 - r1, l1 - r2, CAST(0 AS DOUBLE)) AS gx, greatest(t2 - b1, t1 - b2, CAST(0 AS DOUBLE)) AS gy, CAST(0.01 AS DOUBLE) AS e FROM p)"""
BOX_PAIRS = _PAIRS + """
SELECT page_number, box_id1, box_id2, CASE WHEN ox > 0 AND oy > 0 THEN greatest(l1, l2) END AS i_l, CASE WHEN ox > 0 AND oy > 0 THEN greatest(t1, t2) END AS i_t,
  CASE WHEN ox > 0 AND oy > 0 THEN least(r1, r2) END AS i_r, CASE WHEN ox > 0 AND oy > 0 THEN least(b1, b2) END AS i_b,
  ox * oy AS i_area, r1 >= l2 AND r2 >= l1 AND b1 >= t2 AND b2 >= t1 AS touches,
  ox > 0 AND oy > 0 AND ((ox / greatest(least(r1 - l1, r2 - l2), e) >= CAST(0.20 AS DOUBLE) AND oy / greatest(least(b1 - t1, b2 - t2), e) >= CAST(0.20 AS DOUBLE))
    OR ox * oy / greatest(least((r1 - l1) * (b1 - t1), (r2 - l2) * (b2 - t2)), e) >= CAST(0.15 AS DOUBLE)) AS strong,
  gx <= 12 AND gy <= 12 AS near12, gx <= 24 AND gy <= 24 AS near24, gx <= 55 AND gy <= 55 AS near55, sqrt(gx * gx + gy * gy) AS distance, gx AS gap_x,
  oy / greatest(least(b1 - t1, b2 - t2), e) AS v_overlap, ox * oy / greatest((r1 - l1) * (b1 - t1), CAST(1 AS DOUBLE)) AS covered,
  (l1 + r1) / 2 >= l2 - CAST(1.5 AS DOUBLE) AND (l1 + r1) / 2 <= r2 + CAST(1.5 AS DOUBLE) AND (t1 + b1) / 2 >= t2 - CAST(1.5 AS DOUBLE) AND (t1 + b1) / 2 <= b2 + CAST(1.5 AS DOUBLE) AS centered
FROM q"""


def page_union_area(spark, sf_dir):
    return union_area(dealt(spark, sf_dir, view(spark, sf_dir, "box"), "page_number"), ["page_number"], Box.of(names=LTRB))


_AREA = """xs AS (SELECT page_number, l AS x FROM {b} UNION SELECT page_number, r FROM {b}),
slab AS (SELECT page_number, x AS x0, lead(x) OVER (PARTITION BY page_number ORDER BY x) AS x1 FROM xs),
s AS (SELECT slab.page_number, x0, x1, t, b, max(b) OVER (PARTITION BY slab.page_number, x0 ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM slab JOIN {b} k ON slab.page_number = k.page_number AND k.l <= x0 AND k.r >= x1),
area AS (SELECT page_number, sum((x1 - x0) * greatest(b - greatest(t, coalesce(seen, t)), CAST(0 AS DOUBLE))) AS union_area FROM s GROUP BY page_number)"""
UNION_AREA = duckdb("box") + ", " + _AREA.format(b="box") + " SELECT page_number, union_area FROM area"


def page_coverage(spark, sf_dir):
    """Flagship: coverage of each page by its boxes, clipped to the page, and what kind of page that makes."""
    area = union_area(dealt(spark, sf_dir, view(spark, sf_dir, "box"), "page_number"), ["page_number"], Box.of(names=LTRB), page_box())
    share = G.clamp_ratio(F.col("union_area") / F.lit(PAGE_WIDTH * PAGE_HEIGHT))
    kind = F.when(F.col("coverage") >= 0.12, "dense").when(F.col("coverage") >= 0.05, "medium").otherwise("sparse")
    return area.select("page_number", "union_area", share.alias("coverage")).withColumn("density", kind)


PAGE_COVERAGE = duckdb("box") + """, c AS (SELECT page_number, greatest(l, CAST(0 AS DOUBLE)) AS l, greatest(t, CAST(0 AS DOUBLE)) AS t, least(r, CAST(612 AS DOUBLE)) AS r, least(b, CAST(792 AS DOUBLE)) AS b FROM box
  WHERE least(r, CAST(612 AS DOUBLE)) > greatest(l, CAST(0 AS DOUBLE)) AND least(b, CAST(792 AS DOUBLE)) > greatest(t, CAST(0 AS DOUBLE))), """ + _AREA.format(b="c") + """,
v AS (SELECT page_number, union_area, least(greatest(union_area / CAST(484704 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS coverage FROM area)
SELECT *, CASE WHEN coverage >= CAST(0.12 AS DOUBLE) THEN 'dense' WHEN coverage >= CAST(0.05 AS DOUBLE) THEN 'medium' ELSE 'sparse' END AS density FROM v"""


def merged_intervals(spark, sf_dir):
    return merged_length(view(spark, sf_dir, "box"), ["page_number"], F.col("t"), F.col("b"))


MERGED_INTERVALS = duckdb("box") + """, s AS (SELECT page_number, t, b, max(b) OVER (PARTITION BY page_number ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM box)
SELECT page_number, sum(greatest(b - greatest(t, coalesce(seen, t)), CAST(0 AS DOUBLE))) AS merged_length FROM s GROUP BY page_number"""


def page_envelopes(spark, sf_dir):
    """Envelope of a page's boxes, padded and clipped to the page, and the band widened to the page."""
    pad = 3.0
    e = view(spark, sf_dir, "box").groupBy("page_number").agg(*(f(c).alias(c) for f, c in ((F.min, "l"), (F.min, "t"), (F.max, "r"), (F.max, "b"))))
    p = page_box()
    c = Box.of(names=LTRB).padded(pad)
    return e.select("page_number", F.greatest(c.left, p.left).alias("env_l"), F.greatest(c.top, p.top).alias("env_t"), F.least(c.right, p.right).alias("env_r"), F.least(c.bottom, p.bottom).alias("env_b"), p.left.alias("band_l"), p.right.alias("band_r"))


PAGE_ENVELOPES = duckdb("box") + """ SELECT page_number, greatest(min(l) - 3, CAST(0 AS DOUBLE)) AS env_l, greatest(min(t) - 3, CAST(0 AS DOUBLE)) AS env_t,
  least(max(r) + 3, CAST(612 AS DOUBLE)) AS env_r, least(max(b) + 3, CAST(792 AS DOUBLE)) AS env_b, CAST(0 AS DOUBLE) AS band_l, CAST(612 AS DOUBLE) AS band_r FROM box GROUP BY page_number"""


def vertical_gaps(spark, sf_dir):
    """Gap from each box to the next in reading order, over the page."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_number").orderBy("t", "l", "box_id")
    return view(spark, sf_dir, "box").select("page_number", "box_id", (F.lead("t").over(w) - F.col("b")).alias("gap"))


VERTICAL_GAPS = duckdb("box") + " SELECT page_number, box_id, lead(t) OVER (PARTITION BY page_number ORDER BY t, l, box_id) - b AS gap FROM box"

QUERIES = {"box_normalized": box_normalized, "box_pairs": box_pairs, "union_area": page_union_area, "page_coverage": page_coverage, "merged_intervals": merged_intervals, "page_envelopes": page_envelopes, "vertical_gaps": vertical_gaps}
SQL = {"box_normalized": BOX_NORMALIZED, "box_pairs": BOX_PAIRS, "union_area": UNION_AREA, "page_coverage": PAGE_COVERAGE, "merged_intervals": MERGED_INTERVALS, "page_envelopes": PAGE_ENVELOPES, "vertical_gaps": VERTICAL_GAPS}
