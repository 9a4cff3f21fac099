"""Queries over page layout: bands, bodies, columns, reading order, sections, render plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box
from pagelattice.operators import layout, paragraphs, render
from pagelattice.sources.bridge import PAGE_HEIGHT, PAGE_WIDTH, dealt, duckdb, view

_DP = ["doc_id", "page_number"]


def _lines(spark, sf_dir):
    """Lines of the line view as paragraphs of pages of 12 lines, with page furniture added."""
    l = view(spark, sf_dir, "line")  # noqa: E741
    page = F.floor(F.col("line_index") / 12).cast("int") + 1
    body = l.select("doc_id", page.alias("page_number"), F.col("line_index").alias("item"), "text", F.col("l").alias("left"), (F.lit(120.0) + (F.col("line_index") % 12) * 48).alias("top"), F.col("r").alias("right"), (F.lit(132.0) + (F.col("line_index") % 12) * 48).alias("bottom"), "font_size")
    pages = body.select(*_DP).distinct()
    head = pages.select(*_DP, F.lit(-1).alias("item"), F.lit("Annual  Project Report").alias("text"), F.lit(50.0).alias("left"), F.lit(24.0).alias("top"), F.lit(250.0).alias("right"), F.lit(40.0).alias("bottom"), F.lit(10.0).alias("font_size"))
    foot = pages.select(*_DP, F.lit(-2).alias("item"), F.concat(F.lit("Page "), F.col("page_number")).alias("text"), F.lit(300.0).alias("left"), F.lit(748.0).alias("top"), F.lit(340.0).alias("right"), F.lit(764.0).alias("bottom"), F.lit(9.0).alias("font_size"))
    return body.unionByName(head).unionByName(foot)


_L = duckdb("line") + """, bd AS (SELECT doc_id, CAST(floor(line_index / 12) AS INT) + 1 AS page_number, line_index AS item, text, l, CAST(120 AS DOUBLE) + (line_index % 12) * 48 AS t, r, CAST(132 AS DOUBLE) + (line_index % 12) * 48 AS b FROM line),
pg AS (SELECT DISTINCT doc_id, page_number FROM bd),
it AS (SELECT * FROM bd UNION ALL SELECT doc_id, page_number, -1, 'Annual  Project Report', CAST(50 AS DOUBLE), CAST(24 AS DOUBLE), CAST(250 AS DOUBLE), CAST(40 AS DOUBLE) FROM pg UNION ALL SELECT doc_id, page_number, -2, 'Page ' || page_number, CAST(300 AS DOUBLE), CAST(748 AS DOUBLE), CAST(340 AS DOUBLE), CAST(764 AS DOUBLE) FROM pg)"""


def repeated_bands(spark, sf_dir):
    return layout.repeated_bands(_lines(spark, sf_dir), "doc_id", "page_number", "item", PAGE_WIDTH, PAGE_HEIGHT)


_BANDS = _L + """, n1 AS (SELECT *, (t + b) / 2 AS cy, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS lt FROM it),
n2 AS (SELECT *, CASE WHEN cy <= 110 THEN 'header' WHEN cy >= 682 THEN 'footer' END AS band, CAST(round_even((l + r) / 2 / CAST(612 AS DOUBLE) / CAST(0.08 AS DOUBLE), 0) AS INT) AS bucket, cy / CAST(792 AS DOUBLE) AS y,
  trim(regexp_replace(regexp_replace(lt, '\\d+(?:[.,:/-]\\d+)*', '<n>', 'g'), '[^\\p{L}\\p{M}\\p{N}_<>]+', ' ', 'g')) AS nt FROM n1),
n3 AS (SELECT *, CASE WHEN lt = '' THEN '' WHEN regexp_matches(lt, '^(?:page\\s*)?(?:\\d+|[ivxlcdm]+)(?:\\s*(?:of|/)\\s*(?:\\d+|[ivxlcdm]+))?$') THEN '__page_number__' WHEN length(nt) < 2 THEN '' ELSE nt END AS signature FROM n2),
n4 AS (SELECT * FROM n3 WHERE band IS NOT NULL AND signature <> '' AND length(text) <= 180),
pc AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM it GROUP BY doc_id),
gr AS (SELECT doc_id, band, signature, bucket, count(DISTINCT page_number) AS on_pages, max(y) - min(y) AS spread FROM n4 GROUP BY ALL),
ok AS (SELECT gr.*, least(CAST(0.55 AS DOUBLE) + on_pages / CAST(pages AS DOUBLE) * CAST(0.3 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - spread / CAST(0.035 AS DOUBLE)) * CAST(0.15 AS DOUBLE), CAST(1 AS DOUBLE)) AS confidence FROM gr JOIN pc USING (doc_id)
  WHERE pages >= 2 AND on_pages >= greatest(2, CAST(ceil(pages * CAST(0.5 AS DOUBLE)) AS BIGINT)) AND spread <= CAST(0.035 AS DOUBLE)),
rb AS (SELECT doc_id, page_number, item, band, max(confidence) AS confidence FROM n4 JOIN ok USING (doc_id, band, signature, bucket) GROUP BY ALL)"""
REPEATED_BANDS = _BANDS + " SELECT doc_id, page_number, item, band, confidence FROM rb"


def _banded(spark, sf_dir):
    items = _lines(spark, sf_dir)
    bands = layout.repeated_bands(items, "doc_id", "page_number", "item", PAGE_WIDTH, PAGE_HEIGHT).drop("confidence")
    return items.join(bands, [*_DP, "item"], "left")


def body_boxes(spark, sf_dir):
    return layout.body_box(_banded(spark, sf_dir), _DP, PAGE_WIDTH, PAGE_HEIGHT).select(*_DP, F.col("left").alias("body_l"), F.col("top").alias("body_t"), F.col("right").alias("body_r"), F.col("bottom").alias("body_b"))


BODY_BOXES = _BANDS + """, x AS (SELECT it.*, rb.band FROM it LEFT JOIN rb USING (doc_id, page_number, item)),
g AS (SELECT doc_id, page_number, min(l) FILTER (band IS NULL) AS il, min(t) FILTER (band IS NULL) AS itop, max(r) FILTER (band IS NULL) AS ir, max(b) FILTER (band IS NULL) AS ib, max(b) FILTER (band = 'header') AS h, min(t) FILTER (band = 'footer') AS f FROM x GROUP BY ALL),
k AS (SELECT *, coalesce(least(greatest(h + 3, CAST(0 AS DOUBLE)), CAST(792 AS DOUBLE)), CAST(0 AS DOUBLE)) AS lo, coalesce(greatest(least(f - 3, CAST(792 AS DOUBLE)), CAST(0 AS DOUBLE)), CAST(792 AS DOUBLE)) AS hi FROM g),
z AS (SELECT *, coalesce(greatest(CAST(0 AS DOUBLE), il - CAST(6.12 AS DOUBLE)), CAST(0 AS DOUBLE)) AS bl, coalesce(least(CAST(612 AS DOUBLE), ir + CAST(6.12 AS DOUBLE)), CAST(612 AS DOUBLE)) AS br, coalesce(greatest(lo, itop - 3), lo) AS bt, coalesce(least(hi, ib + 3), hi) AS bb FROM k)
SELECT doc_id, page_number, CASE WHEN br > bl THEN bl ELSE CAST(0 AS DOUBLE) END AS body_l, CASE WHEN bb > bt THEN bt ELSE lo END AS body_t, CASE WHEN br > bl THEN br ELSE CAST(612 AS DOUBLE) END AS body_r, CASE WHEN bb > bt THEN bb ELSE hi END AS body_b FROM z"""


def page_columns(spark, sf_dir):
    """Columns of each page's body (running medians; no SQL form)."""
    b = view(spark, sf_dir, "box").select("page_number", F.concat_ws(":", "box_id", F.col("l").cast("int"), F.col("t").cast("int")).alias("item"), F.lit("twenty characters and more").alias("text"), F.col("l").alias("left"), F.col("t").alias("top"), (F.col("l") + 120).alias("right"), F.col("b").alias("bottom")).distinct()
    return layout.columns(b, ["page_number"], "item")


def reading_order(spark, sf_dir):
    """Order of a page's boxes in two columns with items that span them."""
    b = view(spark, sf_dir, "vector")
    w = F.col("r") - F.col("l")
    items = b.select(
        "page_number", "box_id", F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"), F.when(F.col("t") < 40, "header").when(F.col("t") > 660, "footer").alias("band"),
        F.when(w < 150, F.when(F.col("l") >= 250, 1).otherwise(0)).alias("column_index"), F.when(F.col("page_number") % 4 == 0, 1).otherwise(2).alias("column_count"), (F.col("box_id") % 6 != 5).alias("in_body"), (F.col("page_number") % 5 == 0).alias("rtl"))
    return layout.reading_order(items, ["page_number"], "box_id").select("page_number", "box_id", "role", "reading_order")


READING_ORDER = duckdb("vector") + """, i AS (SELECT page_number, box_id, l, t, r, b, (t + b) / 2 AS cy, CASE WHEN t < 40 THEN 'header' WHEN t > 660 THEN 'footer' END AS band, CASE WHEN r - l < 150 THEN CASE WHEN l >= 250 THEN 1 ELSE 0 END END AS ci, page_number % 4 <> 0 AND box_id % 6 <> 5 AS two, box_id % 6 <> 5 AS in_body, page_number % 5 = 0 AS rtl FROM vector),
j AS (SELECT *, CASE WHEN rtl THEN -l ELSE l END AS x, two AND band IS NULL AS many, two AND band IS NULL AND ci IS NULL AS spans FROM i),
s AS (SELECT page_number, box_id, cy, row_number() OVER (PARTITION BY page_number ORDER BY t, x, b, box_id) AS k FROM j WHERE spans),
g AS (SELECT j.page_number, j.box_id, min(s.k) AS k FROM j JOIN s ON j.page_number = s.page_number AND j.many AND NOT j.spans AND j.cy < s.cy - 2 GROUP BY ALL),
o AS (SELECT j.*, CASE WHEN spans THEN s.k WHEN many THEN coalesce(g.k, 1073741824) ELSE 0 END AS seg, CASE WHEN band IS NOT NULL THEN band WHEN NOT in_body THEN 'unassigned' WHEN spans THEN 'body_spanning' WHEN many THEN 'column' ELSE 'body' END AS role FROM j LEFT JOIN s USING (page_number, box_id) LEFT JOIN g USING (page_number, box_id))
SELECT page_number, box_id, role, CAST(row_number() OVER (PARTITION BY page_number ORDER BY CASE role WHEN 'header' THEN 0 WHEN 'footer' THEN 3 WHEN 'unassigned' THEN 2 ELSE 1 END, seg, CAST(spans AS INT), CASE WHEN many THEN CASE WHEN rtl THEN -coalesce(ci, 0) ELSE coalesce(ci, 0) END ELSE 0 END, t, x, b, box_id) AS INT) AS reading_order FROM o"""


def page_paragraphs(spark, sf_dir):
    """Paragraphs built from the line view (greedy row merge and continuation; no SQL form)."""
    l = view(spark, sf_dir, "line")  # noqa: E741
    lines = l.select("doc_id", "page_number", "line_index", F.floor(F.col("line_index") / 5).cast("int").alias("block"), "text", "font_size", F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    return paragraphs.paragraphs(lines, _DP).select("doc_id", "page_number", "region_number", "text", "left", "top", "right", "bottom", "content_left", "line_count", "marker")


def paragraph_spacing(spark, sf_dir):
    l = view(spark, sf_dir, "line")  # noqa: E741
    return paragraphs.spacing(l, _DP, ["t", "line_index"], F.col("b") - 2, F.col("font_size") * 1.2).select("doc_id", "line_index", "spacing_before")


PARAGRAPH_SPACING = duckdb("line") + """, x AS (SELECT doc_id, line_index, (b - 2) - lag(b - 2) OVER w - greatest(font_size * CAST(1.2 AS DOUBLE), lag(font_size * CAST(1.2 AS DOUBLE)) OVER w) AS d FROM line WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY t, line_index))
SELECT doc_id, line_index, CASE WHEN d > 1 THEN d ELSE CAST(0 AS DOUBLE) END AS spacing_before FROM x"""


def section_groups(spark, sf_dir):
    """Runs of a customer's orders, as pages, that agree in priority and status."""
    o = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), "o_orderpriority", "o_orderstatus")
    return layout.section_groups(o, "doc", "page", ["o_orderpriority", "o_orderstatus"]).select("doc", "page", F.col("section").cast("long").alias("section"))


SECTION_GROUPS = """WITH x AS (SELECT o_custkey AS doc, o_orderkey AS page, CASE WHEN o_orderpriority IS NOT DISTINCT FROM lag(o_orderpriority) OVER w AND o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT doc, page, CAST(sum(nw) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS section FROM x"""


def page_size_groups(spark, sf_dir):
    """First-fit groups of page sizes (ordered fold; no SQL form)."""
    o = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), (F.lit(600.0) + F.col("o_orderkey") % 7).alias("page_width"), (F.lit(790.0) + F.col("o_custkey") % 3).alias("page_height"))
    return layout.size_groups(o, "doc", "page").select("doc", "page", "size_group")


def _items(spark, sf_dir):
    v = dealt(spark, sf_dir, view(spark, sf_dir, "vector"), "page_number")
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "paragraph", "table", "image", "paragraph", "chart", "vector"))), ((F.col("box_id") - 1) % 7 + 1).cast("int"))
    role = F.when(F.col("t") < 40, "header").when(F.col("t") > 660, "footer").when(F.col("l") > 300, "column").otherwise("body")
    v = v.select("page_number", "box_id", kind.alias("kind"), role.alias("role"), F.col("l").alias("left"), F.col("t").alias("top"), F.when(kind == "paragraph", F.col("r")).otherwise(F.col("r") + 150).alias("right"), F.when(kind == "paragraph", F.col("b")).otherwise(F.col("b") + 150).alias("bottom"), F.col("drawing_type").alias("category"))
    order = F.row_number().over(Window.partitionBy("page_number").orderBy("top", "left", "box_id"))
    v = v.withColumns({"reading_order": F.when(kind_is("paragraph"), order), "column_id": F.when(F.col("role") == "column", 2).when(F.col("box_id") % 2 == 0, 1), "region_id": F.when(F.col("box_id") % 3 == 0, 7), "confidence": F.when(F.col("page_number") % 3 == 0, 0.5).otherwise(0.9)})
    share = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) / F.lit(PAGE_WIDTH * PAGE_HEIGHT)
    placement, disposition = render.strategy(F.col("kind"), F.col("category"), F.col("role"), F.col("confidence"), F.lit(None).cast("boolean"), share)
    return v.withColumns({"placement": placement, "disposition": disposition})


def kind_is(name: str):
    return F.col("kind") == name


_I = duckdb("vector") + """, i0 AS (SELECT page_number, box_id, ['paragraph', 'paragraph', 'table', 'image', 'paragraph', 'chart', 'vector'][(box_id - 1) % 7 + 1] AS kind, CASE WHEN t < 40 THEN 'header' WHEN t > 660 THEN 'footer' WHEN l > 300 THEN 'column' ELSE 'body' END AS role, l, t, r AS r0, b AS b0 FROM vector),
i1 AS (SELECT *, CASE WHEN kind = 'paragraph' THEN r0 ELSE r0 + 150 END AS r, CASE WHEN kind = 'paragraph' THEN b0 ELSE b0 + 150 END AS b, CASE WHEN kind = 'paragraph' THEN row_number() OVER (PARTITION BY page_number ORDER BY t, l, box_id) END AS ro, CASE WHEN role = 'column' THEN 2 WHEN box_id % 2 = 0 THEN 1 END AS col, CASE WHEN box_id % 3 = 0 THEN 7 END AS reg, page_number % 3 = 0 AS weak FROM i0),
i2 AS (SELECT *, (t + b) / 2 AS cy, CASE WHEN kind = 'vector' THEN 'overlay' WHEN role IN ('header', 'footer') THEN 'floating' ELSE 'flow' END AS placement, CASE WHEN kind = 'table' THEN CASE WHEN weak THEN 'visual' ELSE 'editable' END WHEN kind IN ('image', 'chart', 'vector') THEN 'visual' ELSE 'editable' END AS disposition FROM i1),
cv AS (SELECT p.page_number, p.box_id, min(c.box_id) AS covered_by FROM i2 p JOIN i2 c ON p.page_number = c.page_number AND p.kind = 'paragraph' AND p.role NOT IN ('header', 'footer') AND c.kind IN ('table', 'image', 'chart')
  AND (p.r - p.l) * (p.b - p.t) > 0 AND greatest(least(p.r, c.r) - greatest(p.l, c.l), CAST(0 AS DOUBLE)) * greatest(least(p.b, c.b) - greatest(p.t, c.t), CAST(0 AS DOUBLE)) / ((p.r - p.l) * (p.b - p.t)) >= CAST(0.85 AS DOUBLE) GROUP BY ALL)"""


def suppressed_paragraphs(spark, sf_dir):
    return render.suppress(_items(spark, sf_dir), ["page_number"], "box_id").where("covered_by is not null").select("page_number", "box_id", "covered_by", "disposition")


SUPPRESSED_PARAGRAPHS = _I + " SELECT page_number, box_id, covered_by, 'skip' AS disposition FROM cv"


def render_order(spark, sf_dir):
    """Order of a page's items: strategy, suppression, anchors by the nearest paragraphs, and sort."""
    items = render.suppress(_items(spark, sf_dir), ["page_number"], "box_id")
    out = render.ordered(render.anchors(items, ["page_number"], "box_id"), ["page_number"], "box_id")
    return out.select("page_number", "box_id", "kind", "placement", "disposition", "anchor", "render_order")


RENDER_ORDER = _I + """, pr AS (SELECT o.page_number, o.box_id, o.cy AS ocy, p.cy AS pcy, CAST(p.ro AS DOUBLE) AS po, coalesce(CASE WHEN o.role IN ('header', 'footer') OR p.role IN ('header', 'footer') THEN o.role = p.role WHEN o.col IS NOT NULL AND p.col IS NOT NULL THEN o.col = p.col
    WHEN o.reg IS NOT NULL AND p.reg IS NOT NULL THEN o.reg = p.reg ELSE true END, false) AS fits FROM i2 o JOIN i2 p ON o.page_number = p.page_number AND o.ro IS NULL AND p.ro IS NOT NULL),
be AS (SELECT page_number, box_id, bool_or(fits) AS f, max(CASE WHEN fits AND pcy <= ocy THEN {'a': pcy, 'b': po} END).b AS fa, min(CASE WHEN fits AND pcy > ocy THEN {'a': pcy, 'b': po} END).b AS fb, max(CASE WHEN pcy <= ocy THEN {'a': pcy, 'b': po} END).b AS aa, min(CASE WHEN pcy > ocy THEN {'a': pcy, 'b': po} END).b AS ab FROM pr GROUP BY ALL),
bt AS (SELECT page_number, box_id, CASE WHEN f THEN fa ELSE aa END AS x, CASE WHEN f THEN fb ELSE ab END AS y FROM be),
an AS (SELECT i2.*, coalesce(CAST(ro AS DOUBLE), CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x + (y - x) / 2 ELSE coalesce(x + CAST(0.5 AS DOUBLE), y - CAST(0.5 AS DOUBLE)) END, CAST(100000 AS DOUBLE) + t) AS anchor, covered_by FROM i2 LEFT JOIN bt USING (page_number, box_id) LEFT JOIN cv USING (page_number, box_id)),
rk AS (SELECT *, CAST(CASE role WHEN 'header' THEN 0 WHEN 'body' THEN 1 WHEN 'column' THEN 3 ELSE 6 END AS DOUBLE) AS rr, CASE placement WHEN 'flow' THEN 1 WHEN 'floating' THEN 2 ELSE 3 END AS pp FROM an)
SELECT page_number, box_id, kind, placement, CASE WHEN covered_by IS NOT NULL THEN 'skip' ELSE disposition END AS disposition, anchor, CAST(row_number() OVER (PARTITION BY page_number ORDER BY pp, CASE WHEN placement = 'flow' THEN anchor ELSE rr END, CASE WHEN placement = 'flow' THEN rr ELSE anchor END, t, l, box_id) AS INT) AS render_order FROM rk"""


def render_actions(spark, sf_dir):
    items = render.suppress(_items(spark, sf_dir), ["page_number"], "box_id")
    decision = F.when(F.col("page_number") % 2 == 0, "native_safe").otherwise("visual_fallback")
    act = render.action(F.col("kind"), F.col("role"), F.col("placement"), F.col("disposition"), decision, F.col("box_id") % 5 != 1)
    return items.groupBy("page_number", act.alias("action")).agg(F.count("*").alias("items"))


RENDER_ACTIONS = _I + """, x AS (SELECT i2.*, CASE WHEN covered_by IS NOT NULL THEN 'skip' ELSE disposition END AS d FROM i2 LEFT JOIN cv USING (page_number, box_id))
SELECT page_number, CASE WHEN kind = 'table' THEN CASE WHEN d = 'skip' OR role IN ('header', 'footer') OR placement <> 'flow' THEN 'ignore' WHEN d = 'editable' AND page_number % 2 = 0 THEN 'render_table' ELSE 'defer_table' END
  WHEN kind = 'paragraph' THEN CASE WHEN d = 'skip' OR role IN ('header', 'footer') OR placement <> 'flow' OR box_id % 5 = 1 THEN 'ignore' ELSE 'render_paragraph' END WHEN d = 'skip' THEN 'ignore' ELSE 'defer_' || kind END AS action, count(*) AS items FROM x GROUP BY ALL"""


def containing_regions(spark, sf_dir):
    v = _items(spark, sf_dir)
    r = v.where(~kind_is("paragraph")).select("page_number", F.col("box_id").alias("region_id"), *(F.col(c).alias(f"x_{c}") for c in Box._fields))
    return render.containing_region(v.where(kind_is("paragraph")).drop("region_id"), r, ["page_number"], "box_id", Box.of(), Box.of("x_"))


CONTAINING_REGIONS = _I + """, p AS (SELECT i.page_number, i.box_id, min(CASE WHEN greatest(least(i.r, x.r) - greatest(i.l, x.l), CAST(0 AS DOUBLE)) * greatest(least(i.b, x.b) - greatest(i.t, x.t), CAST(0 AS DOUBLE)) / greatest((i.r - i.l) * (i.b - i.t), CAST(1 AS DOUBLE)) >= CAST(0.75 AS DOUBLE)
  THEN {'a': greatest((x.r - x.l) * (x.b - x.t), CAST(1 AS DOUBLE)), 'b': x.box_id} END).b AS region_id FROM i2 i JOIN i2 x ON i.page_number = x.page_number AND i.kind = 'paragraph' AND x.kind <> 'paragraph' GROUP BY ALL) SELECT * FROM p"""

def layout_plan(spark, sf_dir):
    """Boxes as paragraphs with an order for most of them and alignments that may be blocked."""
    v = view(spark, sf_dir, "vector")
    p = v.select("page_number", "box_id", F.col("l").alias("left"), F.col("t").alias("top"))
    order = v.where("box_id % 4 <> 0").select("page_number", "box_id", F.lit("body").alias("role"), (F.lit(100) - F.col("box_id")).alias("reading_order"))
    codes = F.when(F.col("box_id") % 3 == 0, F.array(F.lit("low_confidence"), F.lit("reference_mismatch"))).otherwise(F.array().cast("array<string>"))
    align = v.where("box_id % 5 <> 0").select("page_number", "box_id", F.when(F.col("box_id") % 7 == 0, "unknown").otherwise("center").alias("alignment"), F.when(F.col("page_number") % 2 == 0, 0.5).otherwise(0.8).alias("confidence"), codes.alias("issue_codes"))
    return render.layout_plan(p, order, align, ["page_number"], "box_id").select("page_number", "box_id", "role", "word_alignment", "plan_order")


LAYOUT_PLAN = duckdb("vector") + """ SELECT page_number, box_id, CASE WHEN box_id % 4 <> 0 THEN 'body' ELSE 'unassigned' END AS role, CASE WHEN box_id % 5 <> 0 AND box_id % 7 <> 0 AND page_number % 2 <> 0 AND box_id % 3 <> 0 THEN 'center' END AS word_alignment,
  CAST(row_number() OVER (PARTITION BY page_number ORDER BY CASE WHEN box_id % 4 <> 0 THEN 100 - box_id END NULLS LAST, t, l, box_id) AS INT) AS plan_order FROM vector"""

QUERIES = {
    "repeated_bands": repeated_bands, "body_boxes": body_boxes, "page_columns": page_columns, "reading_order": reading_order, "page_paragraphs": page_paragraphs, "paragraph_spacing": paragraph_spacing, "section_groups": section_groups, "page_size_groups": page_size_groups,
    "suppressed_paragraphs": suppressed_paragraphs, "render_order": render_order, "render_actions": render_actions, "containing_regions": containing_regions, "layout_plan": layout_plan}
SQL = {
    "repeated_bands": REPEATED_BANDS, "body_boxes": BODY_BOXES, "reading_order": READING_ORDER, "paragraph_spacing": PARAGRAPH_SPACING, "section_groups": SECTION_GROUPS, "suppressed_paragraphs": SUPPRESSED_PARAGRAPHS,
    "render_order": RENDER_ORDER, "render_actions": RENDER_ACTIONS, "containing_regions": CONTAINING_REGIONS, "layout_plan": LAYOUT_PLAN}
