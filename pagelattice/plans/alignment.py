"""Queries over paragraphs of the line view: alignment, issues, reports and reference boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box
from pagelattice.operators import alignment
from pagelattice.sources.bridge import duckdb, view

_KEYS = ["doc_id", "page_number", "paragraph_no"]


def _results(spark, sf_dir):
    """Paragraphs are three lines in a row; the reference box varies by the paragraph's number."""
    line = view(spark, sf_dir, "line").select("doc_id", "page_number", F.floor(F.col("line_index") / 3).cast("int").alias("paragraph_no"), "line_index", F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    m = alignment.measures(line, _KEYS, ["line_index"])
    k = F.col("paragraph_no") % 4
    edge = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (k + 1).cast("int"))
    m = m.withColumns({"ref_left": edge(72, 20, 0, 60), "ref_right": edge(560, 570, 520, 548), "ref_top": F.lit(50.0), "ref_bottom": F.lit(750.0), "reference_type": F.when(k == 2, "column").otherwise("page_body")})
    return alignment.classify(m, F.col("paragraph_no") % 5 == 4)


def alignment_class(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select(*_KEYS, "line_count", "alignment", F.round("confidence", 6).alias("confidence"), F.round("left_variance", 6).alias("left_variance"), "left_gap", "right_gap", "center_offset", "hanging")


_R = duckdb("line") + """, ln AS (SELECT doc_id, page_number, CAST(floor(line_index / 3) AS INT) AS paragraph_no, line_index, l, t, r, b, r - l AS w,
  row_number() OVER (PARTITION BY doc_id, page_number, floor(line_index / 3) ORDER BY line_index) AS k, count(*) OVER (PARTITION BY doc_id, page_number, floor(line_index / 3)) AS n FROM line),
m AS (SELECT doc_id, page_number, paragraph_no, min(l) AS pl, min(t) AS pt, max(r) AS pr, max(b) AS pb, count(*) AS line_count, coalesce(stddev_pop(l), CAST(0 AS DOUBLE)) AS lv, coalesce(stddev_pop(r), CAST(0 AS DOUBLE)) AS rv, coalesce(stddev_pop((l + r) / 2), CAST(0 AS DOUBLE)) AS cv,
  coalesce(stddev_pop(CASE WHEN k < n THEN l END), CAST(0 AS DOUBLE)) AS ilv, coalesce(stddev_pop(CASE WHEN k < n THEN r END), CAST(0 AS DOUBLE)) AS irv, median(CASE WHEN k < n THEN w END) AS iw, max(CASE WHEN k = n THEN w END) AS lw, max(CASE WHEN k = 1 THEN l END) AS fl, median(CASE WHEN k > 1 THEN l END) AS rl FROM ln GROUP BY ALL),
f AS (SELECT *, CAST([72, 20, 0, 60][paragraph_no % 4 + 1] AS DOUBLE) AS xl, CAST([560, 570, 520, 548][paragraph_no % 4 + 1] AS DOUBLE) AS xr, CASE WHEN paragraph_no % 4 = 2 THEN 'column' ELSE 'page_body' END AS reference_type, paragraph_no % 5 = 4 AS listed FROM m),
g AS (SELECT *, xr - xl AS rw, greatest(pl - xl, CAST(0 AS DOUBLE)) AS lg, greatest(xr - pr, CAST(0 AS DOUBLE)) AS rg, (pl + pr) / 2 - (xl + xr) / 2 AS off, greatest(CAST(8 AS DOUBLE), (xr - xl) * CAST(0.025 AS DOUBLE)) AS th FROM f),
h AS (SELECT *, (pr - pl) / rw AS wr, lw / rw AS lr, CASE WHEN line_count = 1 THEN CAST(1 AS DOUBLE) WHEN iw > 0 THEN lw / iw ELSE CAST(0 AS DOUBLE) END AS lrel, coalesce(rl - fl >= th AND greatest(fl - xl, CAST(0 AS DOUBLE)) <= greatest(th * CAST(1.5 AS DOUBLE), rw * CAST(0.06 AS DOUBLE)), false) AS hanging,
  greatest(CAST(3 AS DOUBLE), rw * CAST(0.015 AS DOUBLE)) AS et, greatest(CAST(6 AS DOUBLE), rw * CAST(0.035 AS DOUBLE)) AS st, greatest(CAST(6 AS DOUBLE), rw * CAST(0.04 AS DOUBLE)) AS bt, greatest(CAST(3 AS DOUBLE), rw * CAST(0.015 AS DOUBLE), rw * CAST(0.025 AS DOUBLE)) AS sv FROM g),
i AS (SELECT *, CASE WHEN rw < 1 THEN 0 WHEN line_count >= 2 AND ilv <= sv AND irv <= sv AND iw / greatest(rw, CAST(1 AS DOUBLE)) >= CAST(0.72 AS DOUBLE) AND lr <= CAST(0.86 AS DOUBLE) AND lrel <= CAST(0.9 AS DOUBLE) AND lg <= st * 2 AND rg <= st * 2 THEN 1 WHEN listed OR hanging THEN 2
  WHEN abs(off) <= st AND abs(lg - rg) <= bt AND wr <= CAST(0.9 AS DOUBLE) AND cv <= st THEN 3 WHEN rg <= st AND lg - rg >= rw * CAST(0.06 AS DOUBLE) AND rv <= sv THEN 4 WHEN lg <= st * CAST(1.5 AS DOUBLE) OR lv <= sv THEN 5 ELSE 6 END AS c FROM h),
j AS (SELECT *, CASE c WHEN 1 THEN 'justify' WHEN 2 THEN 'left' WHEN 3 THEN 'center' WHEN 4 THEN 'right' WHEN 5 THEN 'left' ELSE 'unknown' END AS alignment, least(greatest(CASE c WHEN 0 THEN CAST(0 AS DOUBLE)
  WHEN 1 THEN CAST(0.55 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - lv / greatest(rw * CAST(0.04 AS DOUBLE), CAST(1 AS DOUBLE))) * CAST(0.15 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - rv / greatest(rw * CAST(0.04 AS DOUBLE), CAST(1 AS DOUBLE))) * CAST(0.15 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - lrel) * CAST(0.15 AS DOUBLE) - CASE WHEN line_count = 2 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  WHEN 2 THEN CASE WHEN lv <= et * 2 THEN CAST(0.78 AS DOUBLE) ELSE CAST(0.66 AS DOUBLE) END
  WHEN 3 THEN CAST(0.55 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - abs(off) / greatest(st, CAST(1 AS DOUBLE))) * CAST(0.25 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - abs(lg - rg) / greatest(bt, CAST(1 AS DOUBLE))) * CAST(0.2 AS DOUBLE)
  WHEN 4 THEN CAST(0.55 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - rg / greatest(st, CAST(1 AS DOUBLE))) * CAST(0.25 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - rv / greatest(sv, CAST(1 AS DOUBLE))) * CAST(0.2 AS DOUBLE)
  WHEN 5 THEN CAST(0.5 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - lg / greatest(st * CAST(1.5 AS DOUBLE), CAST(1 AS DOUBLE))) * CAST(0.25 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - lv / greatest(sv, CAST(1 AS DOUBLE))) * CAST(0.2 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS confidence FROM i)"""
ALIGNMENT_CLASS = _R + " SELECT doc_id, page_number, paragraph_no, line_count, alignment, round(confidence, 6) AS confidence, round(lv, 6) AS left_variance, lg AS left_gap, rg AS right_gap, off AS center_offset, hanging FROM j"


def _issued(spark, sf_dir):
    expected = F.when(F.col("paragraph_no") % 3 == 0, "page_body")
    return alignment.issues(_results(spark, sf_dir), expected)


def alignment_issues(spark, sf_dir):
    return _issued(spark, sf_dir).select(*_KEYS, F.explode("issue_codes").alias("code"))


_ISSUES = _R + """, e AS (SELECT *, greatest(CAST(10 AS DOUBLE), rw * CAST(0.08 AS DOUBLE)) AS eg FROM j),
codes AS (SELECT doc_id, page_number, paragraph_no, alignment, confidence, list_filter([CASE WHEN alignment = 'unknown' THEN 'unknown_alignment' END, CASE WHEN confidence < CAST(0.55 AS DOUBLE) THEN 'low_confidence' END,
  CASE WHEN paragraph_no % 3 = 0 AND reference_type <> 'page_body' THEN 'reference_mismatch' END,
  CASE WHEN rw <= 0 THEN NULL WHEN alignment = 'center' AND (abs(off) > greatest(CAST(8 AS DOUBLE), rw * CAST(0.06 AS DOUBLE)) OR abs(lg - rg) > greatest(CAST(8 AS DOUBLE), rw * CAST(0.1 AS DOUBLE))) THEN 'center_geometry_conflict' WHEN alignment = 'right' AND (rg > eg OR lg <= rg) THEN 'right_geometry_conflict'
    WHEN alignment = 'left' AND rg <= eg AND lg > rg * CAST(1.5 AS DOUBLE) AND NOT hanging THEN 'left_geometry_conflict' WHEN alignment = 'justify' AND (line_count < 2 OR (lrel > CAST(0.98 AS DOUBLE) AND lr > CAST(0.95 AS DOUBLE))) THEN 'justify_geometry_conflict' END,
  CASE WHEN pl < xl - 8 OR pt < 42 OR pr > xr + 8 OR pb > 758 THEN 'paragraph_outside_reference' END], lambda x: x IS NOT NULL) AS codes FROM e)"""
ALIGNMENT_ISSUES = _ISSUES + " SELECT doc_id, page_number, paragraph_no, unnest(codes) AS code FROM codes"


def alignment_report(spark, sf_dir):
    r = alignment.report(_issued(spark, sf_dir), ["doc_id"])
    return r.withColumns({"mean_confidence": F.round("mean_confidence", 6), "min_confidence": F.round("min_confidence", 6)})


ALIGNMENT_REPORT = _ISSUES + " SELECT doc_id, count(*) AS results, " + ", ".join(f"CAST(count_if(alignment = '{a}') AS BIGINT) AS {a}_count" for a in ("left", "center", "right", "justify", "unknown")) + """, round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS min_confidence,
  CAST(count_if(confidence < CAST(0.55 AS DOUBLE)) AS BIGINT) AS low_confidence_count, CAST(sum(len(codes)) AS BIGINT) AS warning_count FROM codes GROUP BY doc_id"""


def alignment_result_issues(spark, sf_dir):
    """Results numbered by squares of line pairs against paragraphs of three lines: some lack one, some have two."""
    line = view(spark, sf_dir, "line").select("doc_id", "page_number", "line_index")
    numbered = lambda n: F.floor(F.col("line_index") / n).cast("long")
    paragraphs = line.select("doc_id", "page_number", numbered(3).alias("paragraph_no")).distinct()
    pair = line.select("doc_id", "page_number", numbered(2).alias("q")).distinct()
    results = pair.select("doc_id", "page_number", F.floor(F.col("q") * F.col("q") / 3).cast("long").alias("paragraph_no"))
    return alignment.result_issues(paragraphs, results, _KEYS)


ALIGNMENT_RESULT_ISSUES = duckdb("line") + """, p AS (SELECT DISTINCT doc_id, page_number, CAST(line_index // 3 AS BIGINT) AS paragraph_no FROM line),
s AS (SELECT DISTINCT doc_id, page_number, CAST(line_index // 2 AS BIGINT) AS q FROM line), r AS (SELECT doc_id, page_number, q * q // 3 AS paragraph_no FROM s)
SELECT *, 'missing_result' AS code, 'error' AS severity FROM (SELECT * FROM p EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'extra_result', 'warning' FROM (SELECT * FROM r EXCEPT SELECT * FROM p)
UNION ALL SELECT doc_id, page_number, paragraph_no, 'duplicate_result', 'error' FROM r GROUP BY ALL HAVING count(*) > 1"""


def container_reference(spark, sf_dir):
    """Reference region of each box: regions are the page's wide boxes, by rank of type and area."""
    b = view(spark, sf_dir, "box")
    kinds = F.element_at(F.array(*map(F.lit, ("header", "column", "page_body", "sidebar", "unknown", "footer", "column"))), F.col("box_id"))
    region = b.select("page_number", F.col("box_id").alias("region_id"), kinds.alias("region_type"), (F.col("l") - 60).alias("x_l"), (F.col("t") - 80).alias("x_t"), (F.col("r") + 60).alias("x_r"), (F.col("b") + 80).alias("x_b"))
    item = b.select("page_number", F.concat_ws(":", "box_id", F.col("l").cast("int"), F.col("t").cast("int"), F.col("r").cast("int")).alias("item"), "l", "t", "r", "b").distinct()
    return alignment.references(item, region, ["page_number"], "item", Box.of(names="ltrb"), Box.of("x_", names="ltrb"))


CONTAINER_REFERENCE = duckdb("box") + """, g AS (SELECT page_number, box_id AS region_id, ['header', 'column', 'page_body', 'sidebar', 'unknown', 'footer', 'column'][box_id] AS region_type, [0, 1, 2, 3, 5, 0, 1][box_id] AS rank, l - 60 AS xl, t - 80 AS xt, r + 60 AS xr, b + 80 AS xb FROM box),
i AS (SELECT DISTINCT page_number, box_id || ':' || CAST(l AS INT) || ':' || CAST(t AS INT) || ':' || CAST(r AS INT) AS item, l, t, r, b FROM box),
p AS (SELECT i.page_number, item, rank, (xr - xl) * (xb - xt) AS size, region_id, region_type, greatest(least(r, xr) - greatest(l, xl), CAST(0 AS DOUBLE)) * greatest(least(b, xb) - greatest(t, xt), CAST(0 AS DOUBLE)) / ((r - l) * (b - t)) >= CAST(0.65 AS DOUBLE) AS ok FROM i JOIN g USING (page_number)),
q AS (SELECT page_number, item, min(CASE WHEN ok THEN {'a': rank, 'b': size, 'c': region_id, 'd': region_type} END) AS best FROM p GROUP BY page_number, item)
SELECT page_number, item, best.c AS region_id, coalesce(best.d, 'page') AS reference_type FROM q"""

QUERIES = {"alignment_class": alignment_class, "alignment_issues": alignment_issues, "alignment_report": alignment_report, "alignment_result_issues": alignment_result_issues, "container_reference": container_reference}
SQL = {"alignment_class": ALIGNMENT_CLASS, "alignment_issues": ALIGNMENT_ISSUES, "alignment_report": ALIGNMENT_REPORT, "alignment_result_issues": ALIGNMENT_RESULT_ISSUES, "container_reference": CONTAINER_REFERENCE}
