"""Registered queries over cell borders, grid lines, identifiers, lookups and merge outcomes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.operators import edges, lookups, paths
from pagelattice.plans import folds
from pagelattice.plans import tables as T
from pagelattice.sources import info
from pagelattice.sources.bridge import dealt, duckdb, view

_PAGE, _KEY = ["page_number"], ["table_id"]
# Cells of a page on a raster, and drawings on or near their edges.
_CELLS = """SELECT l_orderkey AS page_number, l_linenumber AS cell, CAST(40 * (l_partkey % 5) AS DOUBLE) AS "left", CAST(20 * (l_suppkey % 6) AS DOUBLE) AS top, CAST(40 * (l_partkey % 5) + 40 AS DOUBLE) AS "right", CAST(20 * (l_suppkey % 6) + 20 AS DOUBLE) AS bottom
  FROM lineitem"""
_DRAWN = """SELECT l_orderkey AS page_number, l_partkey * 10 + l_linenumber AS ordinal, CASE l_linenumber % 3 WHEN 0 THEN 'Rectangle' ELSE 'line' END AS drawing_type, CAST(40 * (l_suppkey % 5) + l_partkey % 3 AS DOUBLE) AS "left", CAST(20 * (l_partkey % 6) + l_suppkey % 2 AS DOUBLE) AS top,
  CAST(40 * (l_suppkey % 5) + l_partkey % 3 + CASE l_linenumber % 3 WHEN 0 THEN 40 WHEN 1 THEN 1 ELSE 90 END AS DOUBLE) AS "right", CAST(20 * (l_partkey % 6) + l_suppkey % 2 + CASE l_linenumber % 3 WHEN 0 THEN 20 WHEN 1 THEN 60 ELSE 1 END AS DOUBLE) AS bottom,
  CASE WHEN l_partkey % 4 = 0 THEN '#111111' END AS stroke_color, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_linenumber AS DOUBLE) END AS stroke_width, CASE WHEN l_suppkey % 3 > 0 THEN '#222222' END AS fill_color, CASE l_suppkey % 4 WHEN 0 THEN '[] 0' WHEN 1 THEN 'Dotted' WHEN 2 THEN '[3 2] 0' END AS dashes FROM lineitem"""


def cell_edge_borders(spark, sf_dir):
    cells = T._table(spark, sf_dir, _CELLS).distinct()
    return edges.cell_borders(cells, T._table(spark, sf_dir, _DRAWN), _PAGE, ["cell", "left", "top"])


CELL_EDGE_BORDERS = f"""WITH c AS (SELECT DISTINCT * FROM ({_CELLS})), d AS (SELECT page_number, ordinal, lower(drawing_type) AS kind, "left" AS dl, top AS dt, "right" AS dr, bottom AS db, coalesce(stroke_width, 0) AS sw, CASE WHEN stroke_width > 0 THEN least(stroke_width, CAST(3.5 AS DOUBLE)) WHEN fill_color IS NOT NULL AND least("right" - "left", bottom - top) <= 3.5 THEN greatest(least("right" - "left", bottom - top), CAST(0.1 AS DOUBLE)) END AS width,
  CASE WHEN dashes = 'Dotted' THEN 'dotted' WHEN dashes = '[3 2] 0' THEN 'dashed' ELSE 'single' END AS style, CASE WHEN stroke_width > 0 THEN coalesce(stroke_color, '000000') ELSE fill_color END AS color FROM ({_DRAWN})),
m AS (SELECT c.*, d.* EXCLUDE (page_number), kind = 'rectangle' AND abs(dl - "left") <= 2.5 AND abs(dt - top) <= 2.5 AND abs(dr - "right") <= 2.5 AND abs(db - bottom) <= 2.5 AS same, (db - dt <= 3.5 OR db - dt <= sw + 2.5) AND greatest(least(dr, "right") - greatest(dl, "left"), 0) / 40 >= 0.45 AS lev, (dr - dl <= 3.5 OR dr - dl <= sw + 2.5) AND greatest(least(db, bottom) - greatest(dt, top), 0) / 20 >= 0.45 AS upr
  FROM c JOIN d ON c.page_number = d.page_number WHERE width IS NOT NULL),
h AS (SELECT *, unnest(['top', 'right', 'bottom', 'left']) AS edge FROM m), k AS (SELECT * FROM h WHERE same OR CASE edge WHEN 'top' THEN lev AND abs((dt + db) / 2 - top) <= 2.5 WHEN 'bottom' THEN lev AND abs((dt + db) / 2 - bottom) <= 2.5 WHEN 'left' THEN upr AND abs((dl + dr) / 2 - "left") <= 2.5 ELSE upr AND abs((dl + dr) / 2 - "right") <= 2.5 END)
SELECT page_number, cell, "left", top, edge, width, style, color FROM k QUALIFY row_number() OVER (PARTITION BY page_number, cell, "left", top, edge ORDER BY width DESC, ordinal, style DESC, color DESC) = 1"""


def grid_line_boxes(spark, sf_dir):
    cells = T._table(spark, sf_dir, _CELLS).withColumn("thickness", (F.col("page_number") % 7).cast("double") / 4)
    return edges.grid_lines(dealt(spark, sf_dir, cells, "page_number", weight=4), _PAGE, F.col("thickness"))


GRID_LINE_BOXES = f"""WITH c AS ({_CELLS}), s AS (SELECT page_number, true AS lev, unnest([top, bottom]) AS p, "left" AS a, "right" AS z FROM c UNION ALL SELECT page_number, false, unnest(["left", "right"]), top, bottom FROM c),
u AS (SELECT DISTINCT * FROM s), g AS (SELECT *, CASE WHEN a <= max(z) OVER w + CAST(0.5 AS DOUBLE) THEN 0 ELSE 1 END AS n FROM u WINDOW w AS (PARTITION BY page_number, lev, p ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, sum(n) OVER (PARTITION BY page_number, lev, p ORDER BY a, z) AS part FROM g), l AS (SELECT page_number, lev, p, min(a) AS a, max(z) AS z, greatest(CAST(page_number % 7 AS DOUBLE) / 4, CAST(0.75 AS DOUBLE)) AS t FROM k GROUP BY page_number, lev, p, part)
SELECT page_number, round(CASE WHEN lev THEN a ELSE p - t / 2 END, 2) AS "left", round(CASE WHEN lev THEN p - t / 2 ELSE a END, 2) AS top, round(CASE WHEN lev THEN greatest(z - a, t) ELSE t END, 2) AS width, round(CASE WHEN lev THEN t ELSE greatest(z - a, t) END, 2) AS height FROM l"""


def item_identifiers(spark, sf_dir):
    """Identifiers of items and tables from whatever attributes a source has."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    odd = lambda n, c: F.when(F.col("p_partkey") % n == 0, c)
    number = lookups.first_integer(odd(3, F.col("p_brand")), odd(4, F.concat(F.lit(" "), F.col("p_size"), F.lit(" "))), odd(5, F.col("p_partkey")))
    kind = lookups.first_category(odd(6, F.col("p_type")), odd(2, F.concat(F.lit("  "), F.col("p_brand"), F.lit("\t"))))
    return p.select("p_partkey", number.alias("number"), kind.alias("category"), lookups.item_id(F.lit("image"), number, F.col("p_size")).alias("item_id"), lookups.table_id(F.col("p_size"), F.col("p_partkey"), odd(7, F.lit("  ")), odd(8, F.col("p_brand"))).alias("table_id"))


ITEM_IDENTIFIERS = """WITH x AS (SELECT *, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size WHEN p_partkey % 5 = 0 THEN p_partkey END AS BIGINT) AS number FROM part)
SELECT p_partkey, number, CASE WHEN p_partkey % 6 = 0 THEN lower(trim(p_type)) WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE '' END AS category, 'image:' || coalesce(number, p_size + 1) AS item_id, 'table:' || p_size || ':' || CASE WHEN p_partkey % 8 = 0 THEN p_brand ELSE CAST(p_partkey + 1 AS VARCHAR) END AS table_id FROM x"""

_NUMBERED = "SELECT l_orderkey AS page_number, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS place, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 4 END AS own FROM lineitem"


def paragraph_numbers(spark, sf_dir):
    return lookups.numbered(T._table(spark, sf_dir, _NUMBERED), _PAGE, ["place"], "own").select("page_number", "place", "own", "item_number")


PARAGRAPH_NUMBERS = f"""WITH RECURSIVE x AS ({_NUMBERED}), f AS (SELECT page_number, place, own, [coalesce(own, 1)] AS used FROM x WHERE place = 1
  UNION ALL SELECT x.page_number, x.place, x.own, list_append(used, list_min(list_filter(range(coalesce(x.own, x.place), coalesce(x.own, x.place) + len(used) + 1), lambda n: NOT list_contains(used, n)))) FROM f JOIN x ON x.page_number = f.page_number AND x.place = f.place + 1)
SELECT page_number, place, own, CAST(used[-1] AS BIGINT) AS item_number FROM f"""

_ITEMS = "SELECT l_orderkey AS page_number, l_linenumber AS item, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 9 END AS source_id, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 6 END AS region_number FROM lineitem"
_LAYOUT = "SELECT l_orderkey AS page_number, l_partkey AS layout_id, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 9 END AS source_id, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 6 END AS region_number FROM lineitem"


def layout_lookups(spark, sf_dir):
    return lookups.with_layout(T._table(spark, sf_dir, _ITEMS), T._table(spark, sf_dir, _LAYOUT), _PAGE)


LAYOUT_LOOKUPS = f"""WITH i AS ({_ITEMS}), l AS ({_LAYOUT}) SELECT page_number, item, source_id, region_number, coalesce((SELECT max(layout_id) FROM l WHERE l.page_number = i.page_number AND l.source_id = i.source_id), (SELECT max(layout_id) FROM l WHERE l.page_number = i.page_number AND l.region_number = i.region_number)) AS layout_id FROM i"""

_MARKED = """SELECT l_orderkey AS page_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS span_index, CAST(l_suppkey % 3 AS INT) AS line_index, CAST(l_partkey % 40 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 16 AS "left", CASE l_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'text' ELSE ' * ' END AS text, CASE WHEN l_orderkey % 4 > 0 THEN '*' END AS marker,
  CASE l_suppkey % 2 WHEN 0 THEN 'Symbol' ELSE 'plainFace' END AS font, CAST(l_quantity AS DOUBLE) / 7 AS font_size FROM lineitem"""


def list_marker_styles(spark, sf_dir):
    return lookups.marker_styles(T._table(spark, sf_dir, _MARKED, "l_orderkey"), _PAGE).withColumn("font_size", F.round("font_size", 6))


LIST_MARKER_STYLES = f"""WITH s AS (SELECT *, trim(text) <> '' AS seen, trim(text) = coalesce(marker, '') AS own, CASE font WHEN 'Symbol' THEN 'Symbol' ELSE 'plain Face' END AS fam, floor(greatest(font_size, CAST(0.5 AS DOUBLE)) * 2 + CAST(0.5 AS DOUBLE)) / 2 AS size FROM ({_MARKED})),
a AS (SELECT page_number, fam, size FROM s WHERE seen AND NOT own QUALIFY row_number() OVER (PARTITION BY page_number ORDER BY line_index, "left", span_index) = 1), b AS (SELECT page_number, size FROM s WHERE seen QUALIFY row_number() OVER (PARTITION BY page_number ORDER BY line_index DESC, "left" DESC, span_index DESC) = 1)
SELECT p.page_number, coalesce(a.fam, 'Arial') AS font, CAST(round(coalesce(a.size, b.size, 11), 6) AS DOUBLE) AS font_size FROM (SELECT DISTINCT page_number FROM s) p LEFT JOIN a USING (page_number) LEFT JOIN b USING (page_number)"""


def _attempts(spark, sf_dir):
    _, c = T._inputs(spark, sf_dir)
    first = c.groupBy("table_id", "row_index", "column_index").agg(F.max("has_content").alias("has_content"), F.min("synthetic").alias("synthetic"), F.max("row_span").alias("want_rows"), F.max("column_span").alias("want_cols"))
    return lookups.merge_attempts(first.withColumns({"geometry": F.lit(0.9), "borderless": F.lit(0.5)}), _KEY)


def merge_outcomes(spark, sf_dir):
    """What merging leaves of each table's confidence; every eleventh is structurally broken."""
    t, _ = T._inputs(spark, sf_dir)
    t = t.select("table_id", "confidence", (F.col("table_id") % 11 == 0).cast("int").alias("structure_errors"), F.lit("editable").alias("disposition"))
    return lookups.merge_outcome(t, _attempts(spark, sf_dir), _KEY).withColumn("confidence", F.round("confidence", 9))


MERGE_OUTCOMES = folds.ACCEPTED_MERGES.split("SELECT x.table_id, row_index, column_index, CAST(h AS INTEGER)")[0] + """, o AS (SELECT table_id, count(*) AS evaluated, count_if(NOT took) AS conflicts FROM f JOIN x USING (table_id, n) WHERE wants GROUP BY table_id),
y AS (SELECT tb.table_id, confidence, CAST(CASE WHEN tb.table_id % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS structure_errors, coalesce(evaluated, 0) AS evaluated, coalesce(conflicts, 0) AS conflicts FROM tb LEFT JOIN o USING (table_id)), b AS (SELECT *, structure_errors > 0 OR conflicts / greatest(evaluated, 1) > CAST(0.25 AS DOUBLE) AS bad FROM y)
SELECT table_id, round(CASE WHEN bad OR evaluated = conflicts THEN confidence ELSE confidence * CAST(0.8 AS DOUBLE) + CAST(0.85 AS DOUBLE) * CAST(0.2 AS DOUBLE) END, 9) AS confidence, structure_errors, CASE WHEN bad THEN 'visual_fallback' ELSE 'editable' END AS disposition, CAST(evaluated AS BIGINT) AS evaluated, CAST(conflicts AS BIGINT) AS conflicts FROM b"""


def renderable_tables(spark, sf_dir):
    t, c = T._inputs(spark, sf_dir)
    t = t.withColumn("disposition", F.when(F.col("table_id") % 5 > 0, "editable").when(F.col("table_id") % 10 == 0, "skip"))
    rows, columns = T._table(spark, sf_dir, T.ROW_SEGMENTS), T._table(spark, sf_dir, T.COLUMN_SEGMENTS)
    whole = c.groupBy("table_id").agg(F.count("*").alias("n")).where("table_id % 3 = 0").select("table_id", *(F.lit(x).alias(n) for x, n in ((0, "row_index"), (0, "column_index"), (3, "row_span"), (3, "column_span"))))
    return lookups.renderable(t, c.select(*whole.columns).unionByName(whole), rows, columns, _KEY)


RENDERABLE_TABLES = T._WITH + f""", every AS (SELECT table_id, row_index AS r, column_index AS k, row_span AS h, column_span AS w FROM c UNION ALL SELECT table_id, 0, 0, 3, 3 FROM tb WHERE table_id % 3 = 0), pos AS (SELECT DISTINCT table_id, i, unnest(generate_series(k, k + w - 1)) AS j FROM (SELECT *, unnest(generate_series(r, r + h - 1)) AS i FROM every WHERE r + h <= 3 AND k + w <= 3)),
cov AS (SELECT table_id, count(*) AS n FROM pos GROUP BY 1), rs AS (SELECT table_id, count(*) AS n FROM ({T.ROW_SEGMENTS}) GROUP BY 1), cs AS (SELECT table_id, count(*) AS n FROM ({T.COLUMN_SEGMENTS}) GROUP BY 1),
z AS (SELECT tb.table_id, CASE WHEN tb.table_id % 5 = 0 THEN 'not_editable' WHEN coalesce(cov.n, 0) < 9 THEN 'uncovered_positions' WHEN coalesce(rs.n, 0) <> 3 THEN 'incomplete_rows' WHEN coalesce(cs.n, 0) <> 3 THEN 'incomplete_columns' END AS reason FROM tb LEFT JOIN cov USING (table_id) LEFT JOIN rs USING (table_id) LEFT JOIN cs USING (table_id))
SELECT table_id, reason IS NULL AS renderable, reason FROM z"""

# What files tell of themselves, from documents: titles, and dates in several forms.
_TOLD = """SELECT doc_id, doc_id % 2 = 0 AS is_pdf, CASE WHEN doc_id % 3 = 0 THEN true END AS is_encrypted, CASE WHEN doc_id % 5 = 0 THEN doc_id * 4 END AS permissions, concat(' ', source, ' ') AS title, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE lang END AS author,
  CASE doc_id % 5 WHEN 0 THEN concat('D:', 2000 + doc_id % 20, '0', 1 + doc_id % 9, '1', doc_id % 10, '2359', 10 + doc_id % 50, '+01.30.') WHEN 1 THEN concat(2000 + doc_id % 20, '0', 1 + doc_id % 9) WHEN 2 THEN concat('D:', 2000 + doc_id % 20, '0', 1 + doc_id % 9, '010030Z') WHEN 3 THEN 'yesterday' ELSE concat('D:', 2000 + doc_id % 20, '0', 1 + doc_id % 9, '01003015-08') END AS made FROM documents"""


def document_info(spark, sf_dir):
    d = spark.sql(_TOLD.replace("FROM documents", "FROM {documents}"), documents=view(spark, sf_dir, "documents"))
    made = F.replace(F.col("made"), F.lit("."), F.lit("'"))
    told = d.select("doc_id", "is_pdf", "is_encrypted", F.lit(None).cast("boolean").alias("needs_pass"), "permissions", F.create_map(F.lit("title"), F.col("title"), F.lit("author"), F.col("author"), F.lit("creationDate"), made).alias("metadata"))
    out = info.document_info(told, view(spark, sf_dir, "line").select("doc_id", "page_number"))
    return out.select("doc_id", "page_count", "is_pdf", "is_encrypted", "needs_pass", "permissions", "title", "author", F.unix_seconds("created").alias("created"))


DOCUMENT_INFO = duckdb("line") + f""", t AS ({_TOLD}), p AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM line GROUP BY 1), m AS (SELECT *, 2000 + doc_id % 20 AS y, 1 + doc_id % 9 AS mo FROM t)
SELECT doc_id, coalesce(n, 0) AS page_count, is_pdf, coalesce(is_encrypted, false) AS is_encrypted, false AS needs_pass, coalesce(permissions, 0) AS permissions, trim(title) AS title, nullif(trim(author), '') AS author,
  CAST(CASE doc_id % 5 WHEN 0 THEN epoch(make_timestamp(y, mo, 10 + doc_id % 10, 23, 59, 10 + doc_id % 50)) - 5400 WHEN 1 THEN epoch(make_timestamp(y, mo, 1, 0, 0, 0)) WHEN 2 THEN epoch(make_timestamp(y, mo, 1, 0, 30, 0)) WHEN 4 THEN epoch(make_timestamp(y, mo, 1, 0, 30, 15)) + 28800 END AS BIGINT) AS created FROM m LEFT JOIN p USING (doc_id)"""

# Drawings of an order: a rectangle in a clip, a triangle, and nested rectangles by either rule.
_SHAPES = """SELECT l_orderkey AS page_number, l_linenumber AS line, l_partkey AS part, CAST(l_linenumber % 4 AS INT) AS kind, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, CAST(10 + l_partkey % 30 AS DOUBLE) AS w, CAST(8 + l_suppkey % 20 AS DOUBLE) AS h FROM lineitem"""


def painted_areas(spark, sf_dir):
    s = T._table(spark, sf_dir, _SHAPES).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_number")  # the work on a row outweighs its bytes
    item = lambda op, *p: F.struct(F.lit(op).alias("op"), F.array(*p).alias("points"))
    x, y, w, h = (F.col(c) for c in "xywh")
    outer, inner = item("re", x, y, x + w, y + h), item("re", x + 2, y + 2, x + w - 2, y + h - 2)
    triangle = F.array(item("l", x, y, x + w, y), item("l", x + w, y, x, y + h), item("l", x, y + h, x, y))
    path = F.when(F.col("kind") == 0, F.array(outer)).when(F.col("kind") == 1, triangle).otherwise(F.array(outer, inner))
    none = F.lit(None).cast(paths.PATH)
    clips = F.when(F.col("kind") == 0, F.array(F.struct(F.array(*map(F.lit, (20.0, 10.0, 60.0, 40.0))).alias("box"), none.alias("path"), F.lit(False).alias("even_odd"))))
    d = s.select("page_number", "line", "part", path.alias("path"), (F.col("kind") == 2).alias("even_odd"), clips.alias("clips"))
    return paths.painted(d, ["page_number", "line", "part"]).select("page_number", "line", "part", F.size("pieces").alias("n_pieces"), F.round("area", 6).alias("area"))


PAINTED_AREAS = f"""SELECT page_number, line, part, CAST(CASE kind WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 1 THEN 1 ELSE CASE WHEN least(x + w, 60) > greatest(x, 20) AND least(y + h, 40) > greatest(y, 10) THEN 1 ELSE 0 END END AS INT) AS n_pieces,
  round(CASE kind WHEN 0 THEN greatest(least(x + w, 60) - greatest(x, 20), 0) * greatest(least(y + h, 40) - greatest(y, 10), 0) WHEN 1 THEN w * h / 2 WHEN 2 THEN w * h - (w - 4) * (h - 4) ELSE w * h END, 6) AS area FROM ({_SHAPES})"""

QUERIES = {
    "cell_edge_borders": cell_edge_borders, "grid_line_boxes": grid_line_boxes, "item_identifiers": item_identifiers, "paragraph_numbers": paragraph_numbers, "layout_lookups": layout_lookups,
    "list_marker_styles": list_marker_styles, "merge_outcomes": merge_outcomes, "renderable_tables": renderable_tables, "document_info": document_info, "painted_areas": painted_areas}
SQL = {
    "cell_edge_borders": CELL_EDGE_BORDERS, "grid_line_boxes": GRID_LINE_BOXES, "item_identifiers": ITEM_IDENTIFIERS, "paragraph_numbers": PARAGRAPH_NUMBERS, "layout_lookups": LAYOUT_LOOKUPS,
    "list_marker_styles": LIST_MARKER_STYLES, "merge_outcomes": MERGE_OUTCOMES, "renderable_tables": RENDERABLE_TABLES, "document_info": DOCUMENT_INFO, "painted_areas": PAINTED_AREAS}
