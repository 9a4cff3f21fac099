"""Queries over whole pages: vector categories, charts, profiles, policies and document roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, clamp_ratio
from pagelattice.operators import profile, vectors
from pagelattice.operators.coverage import union_area
from pagelattice.plans.geometry import page_box
from pagelattice.sources.bridge import PAGE_HEIGHT, PAGE_WIDTH, dealt, duckdb, view

_PAGE = ["page_number"]
_W, _H = PAGE_WIDTH, PAGE_HEIGHT
#: Pages of the bridge hold seven drawings at most, so its charts need four members.
_MEMBERS = 4


def _vectors(spark, sf_dir):
    v = view(spark, sf_dir, "vector")
    return v.select("page_number", "box_id", F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"), "fill_color", "stroke_color", "stroke_width", "drawing_type")


def vector_categories(spark, sf_dir):
    return vectors.categories(_vectors(spark, sf_dir), _PAGE, "box_id", _W, _H, least_members=_MEMBERS).select("page_number", "box_id", "category", "should_render")


_V = duckdb("vector").replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT *, r - l AS w, b - t AS h FROM vector),
f AS (SELECT *, CASE WHEN w * h / CAST(484704 AS DOUBLE) >= CAST(0.9 AS DOUBLE) AND coalesce(fill_color IN ('#FFFFFF', '#FEFEFE', '#FDFDFD'), false) THEN 'background' WHEN w <= 1 AND h <= 1 THEN 'noise'
  WHEN fill_color IS NOT NULL AND fill_color NOT IN ('#FFFFFF', '#FEFEFE', '#FDFDFD') AND (w >= 25 OR h >= 25) AND (l <= 30 OR t <= 30 OR r >= 582 OR b >= 762) THEN 'decorative' END AS first FROM v),
o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page_number) AS n FROM f WHERE first IS NULL AND NOT (l <= 40 OR t <= 40 OR r >= 572 OR b >= 752)) WHERE n >= {members}),
e AS (SELECT x.page_number, x.box_id AS a, y.box_id AS z FROM o x JOIN o y ON x.page_number = y.page_number AND greatest(y.l - x.r, x.l - y.r, CAST(0 AS DOUBLE)) <= 55 AND greatest(y.t - x.b, x.t - y.b, CAST(0 AS DOUBLE)) <= 55),
walk AS (SELECT page_number, a, z FROM e UNION SELECT w.page_number, w.a, e.z FROM walk w JOIN e ON w.page_number = e.page_number AND w.z = e.a),
c AS (SELECT page_number, a AS box_id, min(z) AS component FROM walk GROUP BY page_number, a)""".replace("{members}", str(_MEMBERS))
_CHARTS = _V + """, g AS (SELECT page_number, component, count(*) AS n, max(r) - min(l) AS w, max(b) - min(t) AS h, count_if(o.w >= 80 OR o.h >= 80) AS lines,
  count_if(CASE WHEN drawing_type = 'line' THEN stroke_color IS NOT NULL AND stroke_width >= CAST(1.5 AS DOUBLE) AND o.w <= 130 AND o.h <= 180 ELSE o.w <= 110 AND o.h <= 230 END) AS marks,
  count(DISTINCT coalesce(stroke_color, fill_color)) AS colors FROM o JOIN c USING (page_number, box_id) GROUP BY page_number, component),
k AS (SELECT page_number, component FROM g WHERE n >= {members} AND w >= 120 AND h >= 70 AND w * h / CAST(484704 AS DOUBLE) <= CAST(0.7 AS DOUBLE) AND lines >= 2 AND marks >= 3 AND colors >= 2),
m AS (SELECT page_number, box_id, true AS chart FROM c JOIN k USING (page_number, component)),
z AS (SELECT page_number, box_id, coalesce(first, CASE WHEN chart THEN 'chart' END, CASE WHEN fill_color IS NOT NULL AND w BETWEEN 2 AND 12 AND h BETWEEN 2 AND 12 AND drawing_type IN ('curve', 'compound') THEN 'bullet'
  WHEN drawing_type = 'line' AND ((w >= 80 AND h <= 5) OR (h >= 80 AND w <= 5)) THEN 'separator' ELSE 'unknown' END) AS category FROM f LEFT JOIN m USING (page_number, box_id))""".replace("{members}", str(_MEMBERS))
VECTOR_CATEGORIES = _CHARTS + " SELECT page_number, box_id, category, category NOT IN ('background', 'noise', 'chart', 'bullet') AS should_render FROM z"


def chart_components(spark, sf_dir):
    """Connected components of the drawings that may be part of a chart, within 55 points."""
    v = _vectors(spark, sf_dir)
    b, kind = Box.of(), F.col("drawing_type")
    from pyspark.sql import Window

    open_ = v.where(vectors.first_category(b, F.col("fill_color"), _W, _H).isNull() & vectors.may_chart(b, kind, _W, _H))
    open_ = open_.withColumn("n", F.count("*").over(Window.partitionBy("page_number"))).where(F.col("n") >= _MEMBERS)
    return vectors.components(open_, _PAGE, "box_id")


CHART_COMPONENTS = _V + " SELECT page_number, box_id, component FROM c"


def vector_regions(spark, sf_dir):
    """Greedy drawing groups (order-dependent; no SQL form)."""
    return vectors.groups(vectors.categories(_vectors(spark, sf_dir), _PAGE, "box_id", _W, _H).where("should_render"), _PAGE, "box_id", _W, _H)


def vectors_outside_tables(spark, sf_dir):
    """Drawings whose centre lies in no table box of their page."""
    v = _vectors(spark, sf_dir)
    t = view(spark, sf_dir, "box").where("box_id % 3 = 0").select("page_number", "l", "t", "r", "b")
    return vectors.outside_tables(v, t, _PAGE, Box(v["left"], v["top"], v["right"], v["bottom"]), Box(t["l"], t["t"], t["r"], t["b"])).select("page_number", "box_id")


VECTORS_OUTSIDE_TABLES = duckdb("vector") + """ SELECT page_number, box_id FROM vector v WHERE NOT EXISTS (SELECT 1 FROM box x WHERE x.box_id % 3 = 0 AND x.page_number = v.page_number
  AND (v.l + v.r) / 2 BETWEEN x.l AND x.r AND (v.t + v.b) / 2 BETWEEN x.t AND x.b)"""

_KINDS = ("text", "image", "vector", "table", "chart")


def page_measures(spark, sf_dir):
    """Measures of each page: the box view's ids deal its boxes out to kinds of content."""
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, "text", "image"))), F.col("box_id"))
    boxes = dealt(spark, sf_dir, view(spark, sf_dir, "box"), "page_number").withColumn("kind", kind)
    area = union_area(boxes, ["page_number", "kind"], Box.of(names="ltrb"), page_box())
    wide = area.groupBy("page_number").pivot("kind", list(_KINDS)).agg(F.first(clamp_ratio(F.col("union_area") / F.lit(_W * _H) * 4)))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_count")
    text = F.when(F.col("kind") == "text", F.col("b") - F.col("t"))
    counts = boxes.groupBy("page_number").agg(*map(count, _KINDS), F.max(text).alias("mx"), F.median(text).alias("md"), F.count_if((F.col("kind") == "text") & (F.col("l") >= 300)).alias("right_text"))
    p = counts.join(wide, "page_number").select(
        "page_number", *(F.coalesce(k, F.lit(0.0)).alias(f"{k}_coverage") for k in _KINDS), *(f"{k}_count" for k in _KINDS[1:]), F.col("text_count").alias("paragraph_count"), F.coalesce("mx", F.lit(0.0)).alias("max_font_size"), F.coalesce("md", F.lit(0.0)).alias("median_font_size"),
        (F.col("page_number") % 11 != 0).alias("has_text"), F.when(F.col("right_text") > 0, 2).otherwise(1).alias("column_count"), F.when(F.col("page_number") % 97 == 0, 1).otherwise(0).alias("form_field_count"),
        F.when(F.col("page_number") % 7 == 0, 792.0).otherwise(612.0).alias("page_width"), F.when(F.col("page_number") % 7 == 0, 612.0).otherwise(792.0).alias("page_height"))
    return p


_MEASURES = duckdb("box") + """, k AS (SELECT *, ['text', 'image', 'vector', 'table', 'chart', 'text', 'image'][box_id] AS kind FROM box),
c AS (SELECT page_number, kind, greatest(l, CAST(0 AS DOUBLE)) AS l, greatest(t, CAST(0 AS DOUBLE)) AS t, least(r, CAST(612 AS DOUBLE)) AS r, least(b, CAST(792 AS DOUBLE)) AS b FROM k),
d AS (SELECT * FROM c WHERE r > l AND b > t),
xs AS (SELECT page_number, kind, l AS x FROM d UNION SELECT page_number, kind, r FROM d),
slab AS (SELECT page_number, kind, x AS x0, lead(x) OVER (PARTITION BY page_number, kind ORDER BY x) AS x1 FROM xs),
s AS (SELECT slab.page_number, slab.kind, x0, x1, t, b, max(b) OVER (PARTITION BY slab.page_number, slab.kind, x0 ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM slab JOIN d ON slab.page_number = d.page_number AND slab.kind = d.kind AND d.l <= x0 AND d.r >= x1),
a AS (SELECT page_number, kind, least(greatest(sum((x1 - x0) * greatest(b - greatest(t, coalesce(seen, t)), CAST(0 AS DOUBLE))) / CAST(484704 AS DOUBLE) * 4, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS share FROM s GROUP BY page_number, kind),
n AS (SELECT page_number, """ + ", ".join(f"count_if(kind = '{k}') AS {k}_count" for k in _KINDS) + """, max(CASE WHEN kind = 'text' THEN b - t END) AS mx, median(CASE WHEN kind = 'text' THEN b - t END) AS md, count_if(kind = 'text' AND l >= 300) AS right_text FROM k GROUP BY page_number),
w AS (SELECT page_number, """ + ", ".join(f"coalesce(max(share) FILTER (kind = '{k}'), CAST(0 AS DOUBLE)) AS {k}_coverage" for k in _KINDS) + """ FROM a GROUP BY page_number),
pages_m AS (SELECT n.page_number, """ + ", ".join(f"coalesce({k}_coverage, CAST(0 AS DOUBLE)) AS {k}_coverage" for k in _KINDS) + ", " + ", ".join(f"{k}_count" for k in _KINDS[1:]) + """, text_count AS paragraph_count, coalesce(mx, CAST(0 AS DOUBLE)) AS max_font_size, coalesce(md, CAST(0 AS DOUBLE)) AS median_font_size,
  n.page_number % 11 <> 0 AS has_text, CASE WHEN right_text > 0 THEN 2 ELSE 1 END AS column_count, CASE WHEN n.page_number % 97 = 0 THEN 1 ELSE 0 END AS form_field_count,
  CASE WHEN n.page_number % 7 = 0 THEN CAST(792 AS DOUBLE) ELSE CAST(612 AS DOUBLE) END AS page_width, CASE WHEN n.page_number % 7 = 0 THEN CAST(612 AS DOUBLE) ELSE CAST(792 AS DOUBLE) END AS page_height
  FROM n LEFT JOIN w USING (page_number)),
q1 AS (SELECT *, NOT has_text AND image_count > 0 AND image_coverage >= CAST(0.5 AS DOUBLE) AS requires_ocr, paragraph_count <= 4 AS sparse, CASE WHEN median_font_size > 0 THEN max_font_size / median_font_size ELSE CAST(0 AS DOUBLE) END AS ratio FROM pages_m),
q2 AS (SELECT *, has_text AND text_coverage <= CAST(0.18 AS DOUBLE) AND paragraph_count <= 12 AND ((least(image_coverage + vector_coverage, CAST(1 AS DOUBLE)) >= CAST(0.12 AS DOUBLE)
  AND ((max_font_size >= 24 AND ratio >= CASE WHEN sparse THEN CAST(1.25 AS DOUBLE) ELSE CAST(1.8 AS DOUBLE) END) OR (sparse AND max_font_size >= 36)))
  OR (sparse AND text_coverage <= CAST(0.08 AS DOUBLE) AND max_font_size >= 36 AND (median_font_size <= 0 OR ratio >= CAST(1.5 AS DOUBLE)))) AS cover FROM q1),
q3 AS (SELECT *, CASE WHEN form_field_count > 0 THEN 'form' WHEN requires_ocr THEN 'scanned' WHEN cover THEN 'designed_cover'
  WHEN table_count > 0 AND (table_coverage >= CAST(0.3 AS DOUBLE) OR table_coverage >= greatest(text_coverage, CAST(0.18 AS DOUBLE))) THEN 'table_dominant'
  WHEN chart_count > 0 AND (chart_coverage >= CAST(0.12 AS DOUBLE) OR chart_coverage >= text_coverage) THEN 'chart_dominant'
  WHEN column_count >= 2 AND image_coverage + vector_coverage >= CAST(0.18 AS DOUBLE) AND text_coverage > CAST(0.02 AS DOUBLE) THEN 'magazine'
  WHEN image_coverage >= CAST(0.6 AS DOUBLE) AND text_coverage < CAST(0.12 AS DOUBLE) THEN 'image_dominant' WHEN column_count >= 2 THEN 'multi_column'
  WHEN has_text AND (image_coverage >= CAST(0.2 AS DOUBLE))::INT + (vector_coverage >= CAST(0.15 AS DOUBLE))::INT + (table_coverage >= CAST(0.15 AS DOUBLE))::INT + (chart_coverage >= CAST(0.1 AS DOUBLE))::INT >= 2 THEN 'mixed'
  WHEN has_text THEN 'simple_text' WHEN image_count > 0 OR vector_count > 0 THEN 'image_dominant' ELSE 'unknown' END AS page_type FROM q2),
q4 AS (SELECT *, CASE WHEN requires_ocr THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) + CASE WHEN has_text THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + least(text_coverage * CAST(1.5 AS DOUBLE), CAST(0.4 AS DOUBLE))
  - least(image_coverage * CAST(0.4 AS DOUBLE), CAST(0.3 AS DOUBLE)) - least(vector_coverage * CAST(0.2 AS DOUBLE), CAST(0.2 AS DOUBLE)) - CASE WHEN column_count >= 2 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  - CASE WHEN page_type IN ('designed_cover', 'magazine', 'image_dominant', 'scanned') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS e,
  CAST(0.15 AS DOUBLE) + least(image_coverage * CAST(0.7 AS DOUBLE), CAST(0.5 AS DOUBLE)) + least(vector_coverage * CAST(0.6 AS DOUBLE), CAST(0.4 AS DOUBLE))
  + CASE WHEN page_type IN ('designed_cover', 'magazine', 'image_dominant') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN requires_ocr THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f FROM q3),
q5 AS (SELECT *, least(greatest(e, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS editable_confidence, least(greatest(f, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS fixed_confidence,
  least(greatest(greatest(e, f) * CAST(0.7 AS DOUBLE) + least(e, f) * CAST(0.3 AS DOUBLE) + (CASE WHEN table_count > 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN chart_count > 0 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN column_count >= 2 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN form_field_count > 0 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS hybrid_confidence,
  CASE WHEN requires_ocr THEN greatest(CAST(0.85 AS DOUBLE), image_coverage) WHEN NOT has_text AND image_count > 0 THEN least(image_coverage, CAST(0.75 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS ocr_confidence,
  CASE page_type WHEN 'simple_text' THEN 'editable' WHEN 'image_dominant' THEN 'fixed' WHEN 'scanned' THEN 'ocr' ELSE 'hybrid' END AS recommended_mode FROM q4)"""


def page_profile(spark, sf_dir):
    p = profile.profiles(page_measures(spark, sf_dir))
    return p.select("page_number", *(f"{k}_coverage" for k in _KINDS), "requires_ocr", "page_type", "editable_confidence", "fixed_confidence", "hybrid_confidence", "ocr_confidence", "recommended_mode")


PAGE_PROFILE = _MEASURES + " SELECT page_number, " + ", ".join(f"{k}_coverage" for k in _KINDS) + ", requires_ocr, page_type, editable_confidence, fixed_confidence, hybrid_confidence, ocr_confidence, recommended_mode FROM q5"


def page_policy(spark, sf_dir):
    p = profile.policies(profile.profiles(page_measures(spark, sf_dir)))
    return p.select("page_number", "page_type", *(f"export_{f}" for f in profile.FLAGS), "mode", "policy_confidence", F.array_join("policy_warnings", ",").alias("policy_warnings"))


def _rule(flag: str) -> str:
    visual = "NOT has_text AND (image_count > 0 OR vector_count > 0)"
    facts = {True: "true", False: "false", "has_text": "has_text", "has_vectors": "vector_count > 0", "has_tables": "table_count > 0", "has_forms": "form_field_count > 0", "has_charts": "chart_count > 0", "only_visual": visual, "not_only_visual": f"NOT ({visual})"}
    return "CASE page_type " + " ".join(f"WHEN '{t}' THEN {facts[rule[flag]]}" for t, rule in profile.POLICIES.items()) + " ELSE false END"


_POLICY = _MEASURES + ", r AS (SELECT *, " + ", ".join(f"{_rule(f)} AS r_{f}" for f in profile.FLAGS) + """, recommended_mode = 'editable' AND editable_confidence < CAST(0.55 AS DOUBLE) AS low FROM q5),
pol AS (SELECT *, CASE WHEN low THEN 'hybrid' ELSE recommended_mode END AS mode FROM r)"""
PAGE_POLICY = _POLICY + """ SELECT page_number, page_type, r_text AND (has_text OR r_run_ocr) AS export_text, r_lists AND (has_text OR r_run_ocr) AS export_lists, r_tables AND (table_count > 0 OR page_type = 'table_dominant') AS export_tables,
  r_forms AND (form_field_count > 0 OR page_type = 'form') AS export_forms, r_images AS export_images, r_vectors AND vector_count > 0 AS export_vectors, r_charts AND (chart_count > 0 OR page_type = 'chart_dominant') AS export_charts,
  r_run_ocr AS export_run_ocr, r_full_page_image OR (mode = 'ocr' AND ocr_confidence < CAST(0.5 AS DOUBLE)) AS export_full_page_image, r_region_fallback AS export_region_fallback, mode,
  CASE mode WHEN 'editable' THEN editable_confidence WHEN 'fixed' THEN fixed_confidence WHEN 'ocr' THEN ocr_confidence ELSE hybrid_confidence END AS policy_confidence,
  concat_ws(',', CASE WHEN low THEN 'editable_downgraded' END, CASE WHEN mode = 'hybrid' AND hybrid_confidence < CAST(0.4 AS DOUBLE) THEN 'hybrid_low' END, CASE WHEN mode = 'ocr' AND ocr_confidence < CAST(0.5 AS DOUBLE) THEN 'ocr_low' END) AS policy_warnings FROM pol"""


def document_profile(spark, sf_dir):
    p = profile.policies(profile.profiles(page_measures(spark, sf_dir))).withColumn("doc", F.floor(F.col("page_number") / 40))
    return profile.documents(dealt(spark, sf_dir, p, "doc"), "doc")


DOCUMENT_PROFILE = _POLICY + """, t AS (SELECT page_number // 40 AS doc, page_type, count(*) AS n FROM pol GROUP BY ALL),
u AS (SELECT doc, string_agg(page_type || '=' || n, ',' ORDER BY page_type) AS type_counts, max(n) AS most FROM t GROUP BY doc),
x AS (SELECT t.doc, CASE WHEN count(*) = 1 THEN min(page_type) ELSE 'mixed' END AS dominant_type FROM t JOIN u ON t.doc = u.doc AND t.n = u.most GROUP BY t.doc),
y AS (SELECT page_number // 40 AS doc, count(*) AS page_count, CASE WHEN count(DISTINCT mode) = 1 THEN min(mode) ELSE 'hybrid' END AS mode, count(DISTINCT mode) AS modes, bool_or(has_text) AS has_text, bool_or(requires_ocr) AS requires_ocr,
  bool_or(table_count > 0) AS has_tables, bool_or(chart_count > 0) AS has_charts, count_if(column_count >= 2) AS multi_column_pages, avg(editable_confidence) AS editable_confidence, avg(fixed_confidence) AS fixed_confidence,
  avg(hybrid_confidence) AS hybrid_confidence, avg(ocr_confidence) AS ocr_confidence, count(DISTINCT CASE WHEN page_width > page_height THEN 1 ELSE 0 END) > 1 AS mixed_orientation FROM pol GROUP BY ALL)
SELECT doc, page_count, type_counts, dominant_type, mode, has_text, requires_ocr, has_tables, has_charts, CAST(multi_column_pages AS BIGINT) AS multi_column_pages, editable_confidence, fixed_confidence, hybrid_confidence, ocr_confidence,
  modes > 1 OR mode = 'hybrid' AS requires_hybrid, mixed_orientation FROM y JOIN u USING (doc) JOIN x USING (doc)"""

QUERIES = {"vector_categories": vector_categories, "chart_components": chart_components, "vector_regions": vector_regions, "vectors_outside_tables": vectors_outside_tables, "page_profile": page_profile, "page_policy": page_policy, "document_profile": document_profile}
SQL = {"vector_categories": VECTOR_CATEGORIES, "chart_components": CHART_COMPONENTS, "vectors_outside_tables": VECTORS_OUTSIDE_TABLES, "page_profile": PAGE_PROFILE, "page_policy": PAGE_POLICY, "document_profile": DOCUMENT_PROFILE}
