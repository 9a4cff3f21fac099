"""Registered queries over ruled tables, grid repair and the parts of written documents, with their DuckDB SQL."""

from __future__ import annotations

import io
import math
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F

from pagelattice.operators import lists, media, numbering, reconstruction, regions, ruling, stories
from pagelattice.operators.grouped import worker_path
from pagelattice.plans import lines as L
from pagelattice.plans import styles
from pagelattice.plans import tables as T
from pagelattice.sources import word
from pagelattice.sources.bridge import ROWS, dealt, duckdb, parts, stored, view

_PAGE = ["page_number"]
_D = "AS DOUBLE)"
# Drawings of a page of four orders on a raster of 30 by 20 points: bars across, bars down, and frames.
DRAWINGS = f"""SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_number, CAST(40 + 30 * (l_partkey % 5) {_D} AS "left", CAST(50 + 20 * (l_suppkey % 6) {_D} + CAST(l_partkey % 3 {_D} / 2 AS top,
  CAST(40 + 30 * (l_partkey % 5) + 30 * (1 + l_linenumber % 6) {_D} AS "right", CAST(51 + 20 * (l_suppkey % 6) {_D} + CAST(l_partkey % 3 {_D} / 2 AS bottom, '#000000' AS stroke_color, CAST(1 {_D} AS stroke_width, CAST(NULL AS STRING) AS fill_color FROM lineitem
UNION ALL SELECT CAST(floor(l_orderkey / 4) AS BIGINT), CAST(40 + 30 * (l_suppkey * 7 % 7) {_D} + CAST(l_suppkey % 4 {_D} / 2, CAST(48 + 20 * (l_partkey * 3 % 5) {_D}, CAST(41 + 30 * (l_suppkey * 7 % 7) {_D} + CAST(l_suppkey % 4 {_D} / 2,
  CAST(48 + 20 * (l_partkey * 3 % 5) + 20 * (1 + l_linenumber % 5) {_D}, NULL, NULL, '#112233' FROM lineitem
UNION ALL SELECT CAST(floor(l_orderkey / 4) AS BIGINT), CAST(40 + 30 * (l_partkey % 7) {_D}, CAST(50 + 20 * (l_partkey % 6) {_D}, CAST(100 + 30 * (l_partkey % 7) {_D}, CAST(90 + 20 * (l_partkey % 6) {_D}, CASE WHEN l_suppkey % 2 = 0 THEN '#000000' END, CAST(1 {_D}, NULL FROM lineitem WHERE l_linenumber % 4 = 0"""
SPANS = f"""SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_number, l_orderkey AS block_number, l_linenumber AS line_index, l_partkey AS span_index, concat(l_returnflag, l_linestatus) AS text,
  CAST(40 + l_partkey * 13 % 200 {_D} AS "left", CAST(50 + l_suppkey * 17 % 120 {_D} AS top, CAST(48 + l_partkey * 13 % 200 {_D} AS "right", CAST(56 + l_suppkey * 17 % 120 {_D} AS bottom FROM lineitem"""


# Segments of a line item's drawings, about; dealt by page, all that follows stays in the tasks where they are.
_WEIGHT = 2.5


def _corners(spark, sf_dir):
    drawn = ruling.segments(T._table(spark, sf_dir, DRAWINGS), _PAGE)
    return ruling.corners(ruling.rulings(dealt(spark, sf_dir, drawn, *_PAGE, weight=_WEIGHT), _PAGE), _PAGE)


def ruling_corners(spark, sf_dir):
    return _corners(spark, sf_dir).select("page_number", "x", "y").distinct()


_SEG = f"""WITH RECURSIVE drawn AS ({DRAWINGS.replace("AS STRING", "AS VARCHAR")}), seg AS (
  SELECT page_number, bottom - top <= 3 AS flat, CASE WHEN bottom - top <= 3 THEN (top + bottom) / 2 ELSE ("left" + "right") / 2 END AS p, CASE WHEN bottom - top <= 3 THEN "left" ELSE top END AS a, CASE WHEN bottom - top <= 3 THEN "right" ELSE bottom END AS z FROM drawn WHERE least(bottom - top, "right" - "left") <= 3
  UNION ALL SELECT page_number, true, unnest([top, bottom]), "left", "right" FROM drawn WHERE least(bottom - top, "right" - "left") > 3 AND stroke_color IS NOT NULL
  UNION ALL SELECT page_number, false, unnest(["left", "right"]), top, bottom FROM drawn WHERE least(bottom - top, "right" - "left") > 3 AND stroke_color IS NOT NULL),
s1 AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY page_number, flat ORDER BY p) <= 3 THEN 0 ELSE 1 END AS n FROM seg), s2 AS (SELECT *, sum(n) OVER (PARTITION BY page_number, flat ORDER BY p) AS line FROM s1),
s3 AS (SELECT * REPLACE (avg(p) OVER (PARTITION BY page_number, flat, line) AS p), CASE WHEN a <= max(z) OVER (PARTITION BY page_number, flat, line ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS m FROM s2),
s4 AS (SELECT *, sum(m) OVER (PARTITION BY page_number, flat, line ORDER BY a, z) AS part FROM s3),
joined AS (SELECT page_number, flat, line, part, min(p) AS p, min(a) AS a, max(z) AS z FROM s4 GROUP BY ALL HAVING max(z) - min(a) >= 3),
corner AS (SELECT h.page_number, [h.line, h.part] AS h, [v.line, v.part] AS v, v.p AS x, h.p AS y FROM joined h JOIN joined v ON h.page_number = v.page_number AND h.flat AND NOT v.flat AND v.p BETWEEN h.a - 3 AND h.z + 3 AND h.p BETWEEN v.a - 3 AND v.z + 3)"""
RULING_CORNERS = _SEG + " SELECT DISTINCT page_number, x, y FROM corner"


def ruled_cells(spark, sf_dir):
    return ruling.cells(_corners(spark, sf_dir), _PAGE)


# Every pair of lines right of and below a corner is tried.
_CELL = _SEG + """, box AS (SELECT p.page_number, p.x AS l, p.y AS t, r.x AS r, b.y AS b FROM corner p JOIN corner r ON r.page_number = p.page_number AND r.h = p.h AND r.x > p.x JOIN corner b ON b.page_number = p.page_number AND b.v = p.v AND b.y > p.y
  JOIN corner d ON d.page_number = p.page_number AND d.h = b.h AND d.v = r.v QUALIFY row_number() OVER (PARTITION BY p.page_number, p.x, p.y ORDER BY b.y, r.x) = 1)"""
RULED_CELLS = _CELL + ' SELECT page_number, l AS "left", t AS top, r AS "right", b AS bottom FROM box'


def _tables(spark, sf_dir):
    return ruling.tables(ruled_cells(spark, sf_dir), _PAGE, lambda df: dealt(spark, sf_dir, df, *_PAGE))


def ruled_tables(spark, sf_dir):
    return ruling.summary(_tables(spark, sf_dir), _PAGE)


_TABLE = _CELL + """, node AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY t, l) AS id FROM box), tip AS (SELECT page_number, id, unnest([{'x': l, 'y': t}, {'x': r, 'y': t}, {'x': l, 'y': b}, {'x': r, 'y': b}]) AS c FROM node),
edge AS (SELECT DISTINCT a.page_number, a.id, b.id AS o FROM tip a JOIN tip b ON a.page_number = b.page_number AND a.c = b.c), reach AS (SELECT page_number, id, id AS o FROM node UNION SELECT r.page_number, r.id, e.o FROM reach r JOIN edge e ON e.page_number = r.page_number AND e.id = r.o),
label AS (SELECT page_number, id, min(o) AS root FROM reach GROUP BY ALL HAVING count(*) > 1), tabled AS (SELECT n.*, CAST(dense_rank() OVER (PARTITION BY n.page_number ORDER BY root) - 1 AS INTEGER) AS k FROM node n JOIN label USING (page_number, id)),
lone AS (SELECT *, count(*) OVER (PARTITION BY page_number, k, t) = 1 AND r - l >= CAST(0.9 AS DOUBLE) * greatest(max(r) OVER v - min(l) OVER v, CAST(1 AS DOUBLE)) AS w FROM tabled WINDOW v AS (PARTITION BY page_number, k)),
ends AS (SELECT *, min(CASE WHEN NOT w THEN t END) OVER v AS lo, max(CASE WHEN NOT w THEN t END) OVER v AS hi, max(t) OVER v AS last FROM lone WINDOW v AS (PARTITION BY page_number, k)),
kept AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page_number, k ORDER BY t) - 1 AS INTEGER) AS i, CAST(dense_rank() OVER (PARTITION BY page_number, k ORDER BY l) - 1 AS INTEGER) AS j FROM ends WHERE (lo IS NULL AND t = last) OR t BETWEEN lo AND hi)"""
RULED_TABLES = _TABLE + ' SELECT page_number, k AS table_index, max(i) + 1 AS row_count, max(j) + 1 AS column_count, count(*) AS cells, min(l) AS "left", min(t) AS top, max(r) AS "right", max(b) AS bottom FROM kept GROUP BY page_number, k'


def ruled_cell_texts(spark, sf_dir):
    """Cells of the ruled tables with their spans and the text of the spans in them."""
    return ruling.with_text(_tables(spark, sf_dir), T._table(spark, sf_dir, SPANS), _PAGE)


RULED_CELL_TEXTS = _TABLE + f""", span AS ({SPANS}), held AS (SELECT s.*, k, i, j FROM span s JOIN kept c ON c.page_number = s.page_number AND (s."left" + s."right") / 2 BETWEEN l AND r AND (s.top + s.bottom) / 2 BETWEEN t AND b
  QUALIFY row_number() OVER (PARTITION BY s.page_number, block_number, line_index, span_index ORDER BY k, i, j) = 1),
worded AS (SELECT page_number, k, i, j, block_number, line_index, string_agg(text, '' ORDER BY "left", span_index) AS w FROM held GROUP BY ALL), texts AS (SELECT page_number, k, i, j, trim(string_agg(w, chr(10) ORDER BY block_number, line_index)) AS text FROM worded GROUP BY ALL)
SELECT page_number, k AS table_index, i AS row_index, j AS column_index, CAST((SELECT count(DISTINCT o.t) FROM kept o WHERE o.page_number = c.page_number AND o.k = c.k AND o.t >= c.t AND o.t < c.b) AS INTEGER) AS row_span,
  CAST((SELECT count(DISTINCT o.l) FROM kept o WHERE o.page_number = c.page_number AND o.k = c.k AND o.l >= c.l AND o.l < c.r) AS INTEGER) AS column_span, l AS "left", t AS top, r AS "right", b AS bottom, coalesce(text, '') AS text FROM kept c LEFT JOIN texts USING (page_number, k, i, j)"""


def spans_outside_tables(spark, sf_dir):
    """Spans that stand in no table, as paragraphs are built from them."""
    boxes = ruled_tables(spark, sf_dir)
    out = ruling.outside(boxes, T._table(spark, sf_dir, SPANS), _PAGE, ["table_index"], ["block_number", "line_index", "span_index"], 0.0)
    return out.select("page_number", "block_number", "line_index", "span_index", "text")


SPANS_OUTSIDE_TABLES = _TABLE + f""", tb AS (SELECT page_number, k, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM kept GROUP BY ALL), span AS ({SPANS})
SELECT page_number, block_number, line_index, span_index, text FROM span s WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.page_number = s.page_number AND (s."left" + s."right") / 2 BETWEEN tb.l AND tb.r AND (s.top + s.bottom) / 2 BETWEEN tb.t AND tb.b)"""


def _grid(spark, sf_dir):
    t, c = T._inputs(spark, sf_dir, "l_orderkey")
    c = c.withColumns({"confidence": F.lit(0.9), "borders": F.col("cell").cast("string"), "text": F.lit("x")})
    return t, c


def snapped_cells(spark, sf_dir):
    """Cells of the order grids moved to their boundaries."""
    t, c = _grid(spark, sf_dir)
    out = reconstruction.snapped(c, reconstruction.edges(t, c, ["table_id"]), ["table_id"])
    return out.select("table_id", "cell", "row_index", "column_index", "row_span", "column_span", *reconstruction.SIDES, "moved", "far", F.round("confidence", 9).alias("confidence"))


_EDGE = f"WITH edge AS ({T.GRID_BOUNDARIES}), " + T._WITH.removeprefix("WITH ") + ", sure AS (SELECT table_id, sum(confidence) / count(*) AS g FROM edge GROUP BY table_id)"
_AT = lambda axis, k, name: f"LEFT JOIN edge {name} ON {name}.table_id = c.table_id AND {name}.axis = '{axis}' AND {name}.k = {k}"
_PLACED = f""", placed AS (SELECT c.*, w.position AS nl, n.position AS nt, e.position AS nr, s.position AS nb, g, w.position IS NOT NULL AND n.position IS NOT NULL AND e.position IS NOT NULL AND s.position IS NOT NULL AS fits FROM c {_AT('column', 'c.column_index', 'w')} {_AT('row', 'c.row_index', 'n')} {_AT('column', 'c.column_index + c.column_span', 'e')} {_AT('row', 'c.row_index + c.row_span', 's')} JOIN sure ON sure.table_id = c.table_id),
moves AS (SELECT *, CASE WHEN fits THEN greatest(abs("left" - nl), abs(top - nt), abs("right" - nr), abs(bottom - nb)) END AS moved FROM placed)"""
_SNAPPED = """SELECT table_id, cell, row_index, column_index, row_span, column_span, CASE WHEN fits THEN nl ELSE "left" END AS "left", CASE WHEN fits THEN nt ELSE top END AS top, CASE WHEN fits THEN nr ELSE "right" END AS "right", CASE WHEN fits THEN nb ELSE bottom END AS bottom, moved, coalesce(moved > 4, false) AS far,
  round(CASE WHEN fits THEN least(greatest(CAST(0.9 AS DOUBLE) * CAST(0.7 AS DOUBLE) + g * CAST(0.3 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) ELSE CAST(0.9 AS DOUBLE) END, 9) AS confidence FROM moves"""
SNAPPED_CELLS = _EDGE + _PLACED + " " + _SNAPPED


def reconstructed_cells(spark, sf_dir):
    """Blank cells that fill the gaps of the order grids, with the borders of the table's first cell."""
    t, c = _grid(spark, sf_dir)
    out = reconstruction.reconstructed(t, c, ["table_id"], ["row_index", "column_index", "cell"])
    return out.where("cell is null").select("table_id", F.col("row_index").cast("int").alias("row_index"), F.col("column_index").cast("int").alias("column_index"), *reconstruction.SIDES, "borders", "confidence")


RECONSTRUCTED_CELLS = _EDGE + T._POS + f""", gap AS (SELECT g.table_id, CAST(g.row AS INTEGER) AS row_index, CAST(g.col AS INTEGER) AS column_index, 1 AS row_span, 1 AS column_span FROM grid g LEFT JOIN owned o ON o.table_id = g.table_id AND o.row = g.row AND o.col = g.col WHERE o.n IS NULL),
head AS (SELECT table_id, arg_min(CAST(cell AS VARCHAR), {{'r': row_index, 'c': column_index, 'z': cell}}) AS borders FROM ok WHERE fits GROUP BY table_id)
SELECT c.table_id, row_index, column_index, w.position AS "left", n.position AS top, e.position AS "right", s.position AS bottom, borders, CAST(0.45 AS DOUBLE) AS confidence FROM gap c {_AT('column', 'column_index', 'w')} {_AT('row', 'row_index', 'n')} {_AT('column', 'column_index + 1', 'e')} {_AT('row', 'row_index + 1', 's')} LEFT JOIN head ON head.table_id = c.table_id"""


def reconstructed_tables(spark, sf_dir):
    t, c = _grid(spark, sf_dir)
    return reconstruction.finalized(t, c, ["table_id"]).withColumn("confidence", F.round("confidence", 9))


RECONSTRUCTED_TABLES = _EDGE + T._POS + """, gaps AS (SELECT g.table_id, count(*) AS n FROM grid g LEFT JOIN owned o ON o.table_id = g.table_id AND o.row = g.row AND o.col = g.col WHERE o.n IS NULL GROUP BY 1),
bad AS (SELECT table_id, count(*) AS n FROM (SELECT table_id FROM ok WHERE NOT fits UNION ALL SELECT table_id FROM owned WHERE n > 1 UNION ALL SELECT table_id FROM c GROUP BY table_id, row_index, column_index HAVING count(*) > 1) GROUP BY 1),
made AS (SELECT tb.table_id, coalesce(gaps.n, 0) + coalesce(old.n, 0) AS synthetic_cells, coalesce(bad.n, 0) AS structure_errors, g FROM tb LEFT JOIN gaps USING (table_id) LEFT JOIN bad USING (table_id) LEFT JOIN (SELECT table_id, count_if(synthetic) AS n FROM c GROUP BY 1) old USING (table_id) JOIN sure USING (table_id)),
score AS (SELECT *, least(synthetic_cells / CAST(9 AS DOUBLE), CAST(1 AS DOUBLE)) AS part FROM made), sums AS (SELECT *, least(greatest(CAST(0.9 AS DOUBLE) * CAST(0.45 AS DOUBLE) + g * CAST(0.35 AS DOUBLE) + (1 - part) * CAST(0.2 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS confidence FROM score)
SELECT table_id, CAST(synthetic_cells AS BIGINT) AS synthetic_cells, round(confidence, 9) AS confidence, CAST(structure_errors AS BIGINT) AS structure_errors, CASE WHEN structure_errors > 0 OR part > CAST(0.35 AS DOUBLE) OR confidence < CAST(0.55 AS DOUBLE) THEN 'visual_fallback' ELSE 'editable' END AS disposition FROM sums"""

# Items and editable tables of an order: sources agree for some, tables without a source stand at an index.
_ITEMS = "SELECT l_orderkey AS page_number, l_linenumber AS item_id, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 11 END AS source_id, CAST(l_suppkey % 5 AS INT) AS source_index FROM lineitem"
_TABLES = "SELECT l_orderkey AS page_number, concat('t', l_linenumber) AS table_id, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 11 END AS source_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS table_index FROM lineitem"


def table_matches(spark, sf_dir):
    return reconstruction.matched(T._table(spark, sf_dir, _ITEMS), T._table(spark, sf_dir, _TABLES), _PAGE).select("page_number", "item_id", "source_id", "source_index", "table_id", "matched_by")


TABLE_MATCHES = f"""WITH i AS ({_ITEMS}), t AS ({_TABLES}), own AS (SELECT * FROM t WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_number, source_id ORDER BY table_index) = 1)
SELECT i.page_number, item_id, i.source_id, i.source_index, coalesce(own.table_id, x.table_id) AS table_id, CASE WHEN own.table_id IS NOT NULL THEN 'identity' WHEN x.table_id IS NOT NULL THEN 'index' END AS matched_by
FROM i LEFT JOIN own ON own.page_number = i.page_number AND own.source_id = i.source_id LEFT JOIN t x ON x.page_number = i.page_number AND x.table_index = i.source_index AND x.source_id IS NULL"""

_POLICY = "SELECT o_orderkey AS page_number, o_orderkey % 17 = 0 AS use_page_fallback, CASE WHEN o_custkey % 13 = 0 THEN 'Image_Fallback' ELSE 'editable' END AS mode FROM orders"
_PLANNED = "SELECT l_orderkey AS page_number, l_linenumber AS item_id, CAST(l_linenumber AS INT) AS render_order, CAST(l_linenumber AS INT) AS plan_order, l_partkey % 9 = 0 AS marker_only FROM lineitem WHERE l_orderkey % 3 {}"


def page_instructions(spark, sf_dir):
    """Pages with a plan, pages with paragraphs alone and pages that become a picture."""
    plan, layout = (T._table(spark, sf_dir, _PLANNED.format(x)) for x in ("= 0", "<> 1"))
    policies = spark.sql(_POLICY.replace("FROM orders", "FROM {orders}"), orders=view(spark, sf_dir, "orders"))
    return reconstruction.instructions(plan, layout, policies, _PAGE)


PAGE_INSTRUCTIONS = f"""WITH pol AS ({_POLICY}), plan AS ({_PLANNED.format('= 0')}), lay AS ({_PLANNED.format('<> 1')}), whole AS (SELECT page_number FROM pol WHERE use_page_fallback OR lower(mode) IN ('image_fallback', 'page_fallback'))
SELECT page_number, 'page_fallback' AS provenance, 'page_fallback:' || page_number AS item_id, 0 AS instruction_order, 'policy' AS reason FROM whole UNION ALL SELECT page_number, 'plan', CAST(item_id AS VARCHAR), render_order, 'item' FROM plan
UNION ALL SELECT page_number, 'legacy', CAST(item_id AS VARCHAR), plan_order, 'no_plan' FROM lay WHERE NOT marker_only AND page_number NOT IN (SELECT page_number FROM plan) AND page_number NOT IN (SELECT page_number FROM whole)"""


def numbering_instances(spark, sf_dir):
    """Numbers of the list runs of each document, and the definitions that they share."""
    n = numbering.instances(styles.numbering_definitions(spark, sf_dir), "doc_id", "page_number", "run")
    return n.select("doc_id", "page_number", "run", F.col("num_id").cast("long").alias("num_id"), F.col("abstract_id").cast("long").alias("abstract_id"), "is_new", F.size("levels").alias("levels"), F.array_join(F.transform("overrides", lambda o: F.concat_ws("=", o["level"], o["start"])), ",").alias("overrides"))


NUMBERING_INSTANCES = f"""WITH RECURSIVE def AS ({styles.NUMBERING_DEFINITIONS}), top AS (SELECT doc_id, page_number, run, max(level) AS m, bool_or(format = 'bullet') AS bullet FROM def GROUP BY ALL), every AS (SELECT doc_id, page_number, run, bullet, CAST(unnest(generate_series(0, m)) AS INT) AS level FROM top),
lev AS (SELECT e.doc_id, e.page_number, e.run, e.level, coalesce(format, CASE WHEN bullet THEN 'bullet' ELSE ['decimal', 'lowerLetter', 'lowerRoman', 'upperLetter', 'upperRoman'][e.level % 5 + 1] END) AS f, coalesce(text, CASE WHEN bullet THEN substr('{numbering.BULLET_BY_LEVEL}', e.level % 9 + 1, 1) ELSE '%' || (e.level + 1) || '.' END) AS x,
  coalesce(left_twips, 720 + 360 * e.level) AS lt, coalesce(hanging_twips, least(360, greatest((720 + 360 * e.level) // 2, 240))) AS ht, coalesce(start, 1) AS st FROM every e LEFT JOIN def USING (doc_id, page_number, run, level)),
seq AS (SELECT doc_id, page_number, run, list({{'l': level, 'f': f, 'x': x, 'lt': lt, 'ht': ht}} ORDER BY level) AS sig, count(*) AS n, string_agg(CASE WHEN f <> 'bullet' AND (level = 0 OR st > 1) THEN level || '=' || greatest(st, 1) END, ',' ORDER BY level) AS o FROM lev GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, run) AS num_id FROM seq), fst AS (SELECT *, min(num_id) OVER (PARTITION BY doc_id, sig) AS f1 FROM num)
SELECT doc_id, page_number, run, num_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY f1) - 1 AS abstract_id, num_id = f1 AS is_new, CAST(n AS INT) AS levels, coalesce(o, '') AS overrides FROM fst"""


def continued_lists(spark, sf_dir):
    items = L._items(spark, sf_dir).withColumn("content_left", F.when(F.col("line_index") % 4 == 0, F.col("left") + 3))
    return numbering.continues(items, ["doc_id", "page_number"], ["line_index"]).select("doc_id", "line_index", "continues")


CONTINUED_LISTS = L._MARKED + """, c AS (SELECT *, CASE WHEN line_index % 4 = 0 THEN l + 3 ELSE l END AS cl, greatest(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(marker, ''), '^\\s*(\\d+)', 1), '') AS INTEGER), 1), 1) AS no FROM n)
SELECT doc_id, line_index, coalesce(list_type = lag(list_type) OVER w AND abs(lag(cl) OVER w - cl) <= 18 AND t - lag(b) OVER w <= 42 AND (list_type <> 'number' OR no = lag(no) OVER w + 1), false) AS continues FROM c WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_index)"""

# Pages are orders of a customer; an order's first line is its header, the second its footer.
_PAGES = "SELECT o_custkey AS doc_id, o_orderkey AS page_number, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 792 ELSE 612 END AS DOUBLE) AS width, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 612 ELSE 792 END AS DOUBLE) AS height, CAST(0 AS INT) AS rotation FROM orders"
_PARAGRAPHS = """SELECT o_custkey AS doc_id, l_orderkey AS page_number, CAST(n AS INT) AS reading_order, CASE WHEN n = 1 AND o_custkey % 4 > 0 THEN 'header' WHEN n = 2 THEN 'footer' ELSE 'body' END AS role,
  CASE WHEN n = 1 THEN concat(' Report  of ', o_orderstatus) WHEN n = 2 AND o_custkey % 3 > 0 THEN concat('Page ', l_orderkey, CASE WHEN o_custkey % 3 = 1 THEN ' of 9' ELSE '' END) WHEN n = 2 THEN 'Secret' ELSE l_returnflag END AS text,
  CASE l_linestatus WHEN 'O' THEN 'left' ELSE 'center' END AS alignment, CAST(10 + l_partkey % 50 AS DOUBLE) AS "left", CAST(15 * n AS DOUBLE) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) x JOIN orders ON o_orderkey = l_orderkey"""


def _sectioned(spark, sf_dir, docs=None):
    """Pages with their sections, and paragraphs; of the documents in docs (doc_id), where these are given. Other
    documents' orders and lines go before they are numbered and joined: the documents' orders are a table of known size, so
    that Spark sends it to the lines instead of shuffling these, unless it is large. Lines are read once."""
    orders, lines = view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem")
    if docs is not None:
        orders = stored(orders.join(docs, F.col("o_custkey") == F.col("doc_id"), "left_semi").select("o_custkey", "o_orderkey", "o_orderstatus"))
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    pages = spark.sql(_PAGES.replace("FROM orders", "FROM {orders}"), orders=orders)
    text = _PARAGRAPHS.replace('"', "`").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}")
    paragraphs = spark.sql(text, lineitem=lines, orders=orders)
    if docs is not None:
        paragraphs = stored(paragraphs)
    paged = stories.page_sections(pages, paragraphs, "doc_id", "page_number")
    return paged if docs is None else stored(paged), paragraphs


def document_sections(spark, sf_dir):
    return _sections(*_sectioned(spark, sf_dir))


def _sections(paged, paragraphs):
    bodies = paragraphs.where("role = 'body' and page_number % 2 = 0").groupBy("doc_id", "page_number").agg(F.min("left").alias("left"), F.min("top").alias("top"))
    return stories.sections(paged, bodies, paragraphs, "doc_id", "page_number")


_SECTION = f"""WITH pg AS ({_PAGES}), par AS ({_PARAGRAPHS}), band AS (SELECT doc_id, page_number, string_agg(CASE WHEN role = 'header' THEN v END, chr(1) ORDER BY reading_order) AS h, string_agg(CASE WHEN role = 'footer' THEN v END, chr(1) ORDER BY reading_order) AS f FROM (
  SELECT *, CASE WHEN regexp_matches(lower(trim(text)), '^(page\\s*)?\\d+(\\s*(of|/)\\s*\\d+)?$') THEN '#' ELSE lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) END AS v FROM par WHERE role <> 'body') GROUP BY ALL),
ch AS (SELECT pg.*, CASE WHEN row_number() OVER w > 1 AND width = lag(width) OVER w AND coalesce(h, '') = coalesce(lag(h) OVER w, '') AND coalesce(f, '') = coalesce(lag(f) OVER w, '') THEN 0 ELSE 1 END AS nw FROM pg LEFT JOIN band USING (doc_id, page_number) WINDOW w AS (PARTITION BY pg.doc_id ORDER BY pg.page_number)),
sec AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS INT) AS section FROM ch)"""
DOCUMENT_SECTIONS = _SECTION + """, m AS (SELECT sec.doc_id, section, min(CASE WHEN role = 'body' AND sec.page_number % 2 = 0 THEN "left" END) AS bl, min(CASE WHEN role = 'body' AND sec.page_number % 2 = 0 THEN top END) AS bt, min("left") AS pl, min(top) AS pt FROM sec JOIN par USING (doc_id, page_number) GROUP BY ALL)
SELECT doc_id, section, min(page_number) AS first_page, max(page_number) AS last_page, arg_min(width, page_number) AS width, arg_min(height, page_number) AS height, arg_min(rotation, page_number) AS rotation, CASE WHEN min(pl) IS NULL THEN CAST(36 AS DOUBLE) ELSE greatest(coalesce(min(bl), min(pl)), CAST(18 AS DOUBLE)) END AS margin_left,
  CASE WHEN min(pt) IS NULL THEN CAST(36 AS DOUBLE) ELSE greatest(coalesce(min(bt), min(pt)), CAST(18 AS DOUBLE)) END AS margin_top, CAST(36 AS DOUBLE) AS margin_right, CAST(36 AS DOUBLE) AS margin_bottom FROM sec LEFT JOIN m USING (doc_id, section) GROUP BY doc_id, section"""


def section_stories(spark, sf_dir):
    paged, paragraphs = _sectioned(spark, sf_dir)
    s = stories.stories(paged, paragraphs, "doc_id", "page_number")
    return s.select("doc_id", "section", "story", "story_order", "text", "alignment", "field.prefix", "field.has_total")


SECTION_STORIES = _SECTION + """ SELECT doc_id, section, role AS story, CAST(row_number() OVER (PARTITION BY doc_id, section, role ORDER BY reading_order) AS INT) AS story_order, trim(text) AS text, alignment, CASE WHEN text LIKE 'Page %' THEN 'Page ' END AS prefix, CASE WHEN text LIKE 'Page %' THEN text LIKE '% of %' END AS has_total
  FROM par JOIN (SELECT doc_id, section, min(page_number) AS page_number FROM sec GROUP BY ALL) USING (doc_id, page_number) WHERE role <> 'body'"""

# Pictures of documents: the bytes are a source's and a language's names, or missing.
_IMAGES = "SELECT doc_id % 50 AS doc_id, doc_id AS image, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE concat(source, lang) END AS data, CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN 'png' ELSE 'xyz' END AS ext FROM documents"


def _images(spark, sf_dir):
    d = spark.sql(_IMAGES.replace("FROM documents", "FROM {documents}"), documents=view(spark, sf_dir, "documents"))
    return d.withColumn("data", F.encode("data", "UTF-8"))


def document_media(spark, sf_dir):
    i = _images(spark, sf_dir)
    kept = media.media_bytes(i, media.media(i, "doc_id", ["image"]), ["image"])
    return kept.select("doc_id", "sha", "image", "ext", "refs", F.octet_length("data").alias("bytes")).join(media.missing(i, "doc_id"), "doc_id", "right")


DOCUMENT_MEDIA = f"""WITH i AS ({_IMAGES}), m AS (SELECT doc_id, sha256(data) AS sha, min(image) AS image, arg_min(CASE WHEN ext = '.JPG' THEN 'jpg' ELSE 'png' END, image) AS ext, count(*) AS refs, CAST(octet_length(encode(any_value(data))) AS INT) AS bytes FROM i WHERE data <> '' GROUP BY doc_id, sha256(data)),
a AS (SELECT doc_id, count(*) AS images, CAST(count_if(coalesce(data, '') = '') AS BIGINT) AS missing FROM i GROUP BY 1) SELECT doc_id, sha, image, ext, refs, bytes, images, missing FROM a LEFT JOIN m USING (doc_id)"""


def region_layout(spark, sf_dir):
    """Indents and space of the lines of the documents as regions; every ninth is a caption, every thirteenth a heading."""
    line = view(spark, sf_dir, "line")
    n = F.col("line_index")
    text = F.when(n % 9 == 4, F.concat(F.lit("( table "), n, F.lit(") "), F.col("text"))).when(n % 9 == 5, F.concat(F.lit("(Tables "), F.col("text"))).otherwise(F.col("text"))
    r = line.select("doc_id", "page_number", "line_index", text.alias("text"), F.col("l").alias("left"), (F.col("t") + F.col("doc_id") % 3 * n).alias("top"), (F.col("b") + F.col("doc_id") % 3 * n).alias("bottom"), F.lit(80.0).alias("content_left"), F.when(n % 2 == 0, F.col("l") + 12).alias("first_line_left"), (n % 13 == 0).alias("is_heading"), (F.col("doc_id") % 4 == 0).alias("is_cover"))
    return stories.region_layout(r, ["doc_id", "page_number"], ["line_index"]).select("doc_id", "line_index", "left_indent", "first_line_indent", "spacing_before", "is_caption", "keep_next")


REGION_LAYOUT = duckdb("line") + """, r AS (SELECT doc_id, page_number, line_index, l, t + doc_id % 3 * line_index AS t, b + doc_id % 3 * line_index AS b FROM line)
SELECT doc_id, line_index, greatest(l - 80, CAST(0 AS DOUBLE)) AS left_indent, CASE WHEN line_index % 2 = 0 THEN CAST(12 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS first_line_indent, CASE WHEN lag(b) OVER w IS NULL THEN CAST(0 AS DOUBLE) WHEN line_index % 9 = 4 THEN CAST(12 AS DOUBLE) ELSE least(greatest(t - lag(b) OVER w, CAST(0 AS DOUBLE)), CASE WHEN doc_id % 4 = 0 THEN CAST(144 AS DOUBLE) ELSE CAST(42 AS DOUBLE) END) END AS spacing_before,
  line_index % 9 = 4 AS is_caption, line_index % 13 = 0 AS keep_next FROM r WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_index)"""


def read_contents(files):
    """What the packages hold, read back from their XML: paragraphs, numbered ones, page breaks, sections, headers, footers,
    fields, pictures, media parts and numbers."""
    names = ("paragraphs", "numbered", "page_breaks", "sections", "headers", "footers", "fields", "pictures", "media_parts", "numbers")
    worker_path(files)
    w = f"{{{word._NAMES['w']}}}"

    def count(blob):
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist() if n.endswith((".xml", ".rels"))}
            body = parts["word/document.xml"]
            of = lambda root, tag: sum(1 for _ in root.iter(w + tag))
            stories_ = [r for n, r in parts.items() if n.startswith(("word/header", "word/footer"))]
            breaks = sum(1 for b in body.iter(f"{w}br") if b.get(f"{w}type") == "page")
            held = sum(1 for p in body.find(f"{w}body") if p.tag == f"{w}p" and p.find(f"{w}pPr/{w}sectPr") is None) - breaks
            numbers = of(parts["word/numbering.xml"], "num") if "word/numbering.xml" in parts else 0
            headers, footers = (sum(n.startswith(f"word/{k}") for n in parts) for k in ("header", "footer"))
            return held, of(body, "numPr"), breaks, of(body, "sectPr"), headers, footers, sum(of(s, "instrText") for s in stories_), sum(1 for _ in body.iter(f"{{{word._NAMES['wp']}}}inline")), sum(n.startswith("word/media/") for n in z.namelist()), numbers

    def run(batches):
        for b in batches:
            rows = [count(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names)))], names=["doc_id", *names])

    return files.select("doc_id", "docx").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


# Weights of a document that gets a file and of a page in it, for tasks of about 500 documents or 10,000 pages.
_FILE, _PAGE_WEIGHT = 300, 15


def docx_contents(spark, sf_dir):
    """Files of all documents' lines, with their lists numbered, pictures, and sections by customer, read back."""
    runs_ = stored(lists.sequences(L._items(spark, sf_dir), ["doc_id", "page_number"], ["line_index"]).withColumn("run", F.col("run").cast("long")))
    numbers = stored(numbering.instances(stored(styles.numbering_definitions(spark, sf_dir, runs_)), "doc_id", "page_number", "run"))
    items = numbering.numbered(runs_, numbers, "doc_id", "page_number", "run").select("doc_id", "page_number", F.col("line_index").alias("render_order"), F.lit("paragraph").alias("kind"), "text", "font_size", "num_id", (F.col("line_index") % 3).cast("int").alias("level"), F.lit(None).cast("string").alias("sha"), *(F.col(c).cast("double") for c in ("left", "top", "right", "bottom")))
    i = _images(spark, sf_dir)
    kept = media.media_bytes(i, media.media(i, "doc_id", ["image"]), ["image"])
    pictures = media.references(i).select("doc_id", F.lit(1).alias("page_number"), (F.col("image") + 100000).cast("int").alias("render_order"), F.lit("image").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("long").alias("num_id"), F.lit(None).cast("int").alias("level"), "sha", *(F.lit(x).alias(c) for c, x in (("left", 0.0), ("top", 0.0), ("right", 10.0), ("bottom", 10.0))))
    # a file is of a document that has lines or pictures: sections of the others' pages would be dropped by packages()
    docs = stored(runs_.select("doc_id").unionByName(i.select("doc_id")).distinct())
    paged, paragraphs = _sectioned(spark, sf_dir, docs)
    sections = _sections(paged, paragraphs)
    tasks = max(parts(spark, sf_dir, _FILE, "documents"), math.ceil(paged.count() * _PAGE_WEIGHT / ROWS))
    files = word.packages(items.unionByName(pictures), "doc_id", sections, stories.stories(paged, paragraphs, "doc_id", "page_number"), numbers, kept, tasks=tasks)
    return read_contents(files)


DOCX_CONTENTS = styles.NUMBERING_DEFINITIONS.split(" SELECT doc_id, page_number, run, level, kind, CASE")[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""", nums AS (SELECT doc_id, count(*) AS numbers FROM (SELECT DISTINCT doc_id, page_number, run FROM it) GROUP BY 1), numbered AS (SELECT doc_id, count(*) AS numbered FROM it GROUP BY 1),
im AS ({_IMAGES}), pic AS (SELECT doc_id, count_if(data <> '') AS pictures, count(DISTINCT nullif(data, '')) AS media_parts FROM im GROUP BY 1),
{_SECTION.removeprefix("WITH ")}, sc AS (SELECT doc_id, section, min(page_number) AS page_number, max(page_number) AS last FROM sec GROUP BY ALL), st AS (SELECT sc.doc_id, sc.section, count(CASE WHEN role = 'header' THEN 1 END) AS h, count(CASE WHEN role = 'footer' THEN 1 END) AS f, count(CASE WHEN text LIKE 'Page %' THEN 1 END) + count(CASE WHEN text LIKE 'Page % of %' THEN 1 END) AS fields FROM sc LEFT JOIN par ON par.doc_id = sc.doc_id AND par.page_number = sc.page_number AND role <> 'body' GROUP BY ALL),
sd AS (SELECT doc_id, count(*) AS sections, count_if(h > 0) + CASE WHEN sum(h + f) > 0 AND count_if(h = 0) > 0 THEN 1 ELSE 0 END AS headers, count_if(f > 0) + CASE WHEN sum(h + f) > 0 AND count_if(f = 0) > 0 THEN 1 ELSE 0 END AS footers, sum(fields) AS fields FROM st GROUP BY 1),
flow AS (SELECT doc_id, page_number, line_index AS ord, 1 AS shown, 0 AS cut FROM line UNION ALL SELECT doc_id, 1, 100000 + image, CASE WHEN data <> '' THEN 1 ELSE 0 END, 0 FROM im UNION ALL SELECT doc_id, last, NULL, 0, 1 FROM sc),
step AS (SELECT *, row_number() OVER w AS n, lag(cut) OVER w AS after, last_value(CASE WHEN cut = 0 THEN page_number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, ord NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_page FROM flow WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, ord NULLS LAST)),
got AS (SELECT doc_id, sum(shown) AS paragraphs, count(CASE WHEN cut = 0 AND coalesce(after, 0) = 0 AND last_page <> page_number THEN 1 END) AS page_breaks, max(CASE WHEN cut = 0 THEN n END) AS last_item, max(CASE WHEN cut = 1 THEN n END) AS last_cut FROM step GROUP BY 1 HAVING count(CASE WHEN cut = 0 THEN 1 END) > 0)
SELECT doc_id, CAST(paragraphs AS BIGINT) AS paragraphs, coalesce(numbered, 0) AS numbered, CAST(page_breaks AS BIGINT) AS page_breaks, CAST(coalesce(sections, 0) + CASE WHEN last_cut IS NULL OR last_item > last_cut THEN 1 ELSE 0 END AS BIGINT) AS sections,
  CAST(coalesce(headers, 0) + CASE WHEN coalesce(headers, 0) + coalesce(footers, 0) > 0 AND last_item > last_cut AND NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = got.doc_id AND h = 0) THEN 1 ELSE 0 END AS BIGINT) AS headers,
  CAST(coalesce(footers, 0) + CASE WHEN coalesce(headers, 0) + coalesce(footers, 0) > 0 AND last_item > last_cut AND NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = got.doc_id AND f = 0) THEN 1 ELSE 0 END AS BIGINT) AS footers, CAST(coalesce(fields, 0) AS BIGINT) AS fields, CAST(coalesce(pictures, 0) AS BIGINT) AS pictures, coalesce(media_parts, 0) AS media_parts, coalesce(numbers, 0) AS numbers
FROM got LEFT JOIN numbered USING (doc_id) LEFT JOIN nums USING (doc_id) LEFT JOIN pic USING (doc_id) LEFT JOIN sd USING (doc_id)"""

# Columns and regions of a page are the lines of an order; paragraphs are members of the region of their part's class.
_COLUMNS = "SELECT l_orderkey AS page_number, l_linenumber AS column_id, CAST(l_partkey % 7 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 16 AS \"left\", CAST(l_suppkey % 3 AS DOUBLE) AS top FROM lineitem WHERE l_linenumber % 3 < 2"
_REGIONS = "SELECT l_orderkey AS page_number, l_linenumber AS region_id, CASE WHEN l_partkey % 3 = 0 THEN 'page_body' ELSE 'column' END AS region_type, CAST(l_suppkey % 11 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 16 AS \"left\", CAST(1 AS DOUBLE) AS top FROM lineitem"
_MEMBERS = "SELECT l_orderkey AS page_number, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS paragraph, CAST(CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS INT) AS region, CAST(l_suppkey % 10 AS INT) AS b1, CAST(l_partkey % 4 AS INT) AS b2 FROM lineitem"


def column_layout_regions(spark, sf_dir):
    return regions.column_regions(T._table(spark, sf_dir, _COLUMNS), T._table(spark, sf_dir, _REGIONS), _PAGE).select("page_number", "column_id", "region_id")


COLUMN_LAYOUT_REGIONS = f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY "left", top) AS k FROM ({_COLUMNS})), r AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY "left", top) AS k FROM ({_REGIONS}) WHERE region_type = 'column')
SELECT c.page_number, column_id, region_id FROM c LEFT JOIN r ON r.page_number = c.page_number AND r.k = c.k"""


def region_members(spark, sf_dir):
    """Members, source blocks and reading order of regions; every fourth line of an order isn't in the reading order."""
    items = T._table(spark, sf_dir, _MEMBERS).withColumn("source_block_numbers", F.array("b1", "b2"))
    found = regions.members(items, _PAGE, "region", ["paragraph"])
    entries = items.where("paragraph % 4 > 0").select("page_number", "paragraph", (F.lit(100) - F.col("paragraph")).cast("int").alias("reading_order"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    orders = regions.region_orders(found, entries, _PAGE, "region")
    return found.select("page_number", "region", listed("members"), listed("blocks")).join(orders, ["page_number", "region"])


REGION_MEMBERS = f"""WITH m AS ({_MEMBERS}), e AS (SELECT page_number, region, paragraph, unnest([b1, b2]) AS b, unnest([1, 2]) AS w FROM m WHERE region IS NOT NULL), f AS (SELECT page_number, region, b, min({{'p': paragraph, 'w': w}}) AS pl FROM e GROUP BY ALL),
bl AS (SELECT page_number, region, string_agg(CAST(b AS VARCHAR), ',' ORDER BY pl) AS blocks FROM f GROUP BY ALL)
SELECT page_number, region, string_agg(CAST(paragraph AS VARCHAR), ',' ORDER BY paragraph) AS members, any_value(blocks) AS blocks, CAST(min(CASE WHEN paragraph % 4 > 0 THEN 100 - paragraph END) AS INT) AS reading_order FROM m JOIN bl USING (page_number, region) GROUP BY page_number, region"""

_CELL_SPANS = "SELECT l_orderkey AS page_number, CAST(l_partkey % 2 AS INT) AS cell, l_linenumber AS span, CAST(l_suppkey % 13 AS DOUBLE) / 2 + CAST(l_linenumber AS DOUBLE) / 64 AS origin_y, CAST(l_partkey % 97 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 16 AS \"left\" FROM lineitem"


def cell_lines(spark, sf_dir):
    return regions.baseline_lines(T._table(spark, sf_dir, _CELL_SPANS), ["page_number", "cell"]).select("page_number", "cell", "span", "line", "place")


CELL_LINES = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page_number, cell ORDER BY origin_y, "left") AS n FROM ({_CELL_SPANS})),
f AS (SELECT page_number, cell, span, "left", n, origin_y AS first, 0 AS line FROM s WHERE n = 1 UNION ALL SELECT s.page_number, s.cell, s.span, s."left", s.n, CASE WHEN abs(origin_y - first) > 2 THEN origin_y ELSE first END, CASE WHEN abs(origin_y - first) > 2 THEN line + 1 ELSE line END FROM f JOIN s ON s.page_number = f.page_number AND s.cell = f.cell AND s.n = f.n + 1)
SELECT page_number, cell, span, CAST(line AS INT) AS line, CAST(row_number() OVER (PARTITION BY page_number, cell, line ORDER BY "left") - 1 AS INT) AS place FROM f"""

QUERIES = {
    "ruling_corners": ruling_corners, "ruled_cells": ruled_cells, "ruled_tables": ruled_tables, "ruled_cell_texts": ruled_cell_texts, "spans_outside_tables": spans_outside_tables,
    "snapped_cells": snapped_cells, "reconstructed_cells": reconstructed_cells, "reconstructed_tables": reconstructed_tables, "table_matches": table_matches, "page_instructions": page_instructions,
    "numbering_instances": numbering_instances, "continued_lists": continued_lists, "document_sections": document_sections, "section_stories": section_stories, "document_media": document_media,
    "region_layout": region_layout, "docx_contents": docx_contents, "column_layout_regions": column_layout_regions, "region_members": region_members, "cell_lines": cell_lines}
SQL = {
    "ruling_corners": RULING_CORNERS, "ruled_cells": RULED_CELLS, "ruled_tables": RULED_TABLES, "ruled_cell_texts": RULED_CELL_TEXTS, "spans_outside_tables": SPANS_OUTSIDE_TABLES,
    "snapped_cells": SNAPPED_CELLS, "reconstructed_cells": RECONSTRUCTED_CELLS, "reconstructed_tables": RECONSTRUCTED_TABLES, "table_matches": TABLE_MATCHES, "page_instructions": PAGE_INSTRUCTIONS,
    "numbering_instances": NUMBERING_INSTANCES, "continued_lists": CONTINUED_LISTS, "document_sections": DOCUMENT_SECTIONS, "section_stories": SECTION_STORIES, "document_media": DOCUMENT_MEDIA,
    "region_layout": REGION_LAYOUT, "docx_contents": DOCX_CONTENTS, "column_layout_regions": COLUMN_LAYOUT_REGIONS, "region_members": REGION_MEMBERS, "cell_lines": CELL_LINES}
