"""Queries over runs, styles, borders, widths and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions import text as X
from pagelattice.functions.geometry import Box
from pagelattice.operators import lists, numbering, runs, styles
from pagelattice.plans import lines as L
from pagelattice.sources.bridge import dealt, duckdb, view



def _cells(spark, sf_dir):
    """Every box as a cell; its content lies inside by arithmetic on the id, and may be missing."""
    b = view(spark, sf_dir, "vector").select("page_number", "box_id", "l", "t", "r", "b", "fill_color")
    k = F.col("box_id")
    inner = F.when(k % 5 != 0, True)
    c = b.withColumns({
        "x_l": F.when(inner, F.col("l") + k % 4 * 3), "x_r": F.when(inner, F.col("r") - F.col("page_number") % 3 * 4), "x_t": F.when(inner, F.col("t") + k % 3), "x_b": F.when(inner, F.col("b") - F.col("page_number") % 2 * 2)})
    h, v = styles.cell_alignment(Box.of(names="ltrb"), Box.of("x_", names="ltrb"), F.lit(10.0), F.col("page_number") % 10 == 0)
    return c.withColumns({"horizontal": F.when(F.col("x_l").isNotNull(), h).otherwise("left"), "vertical": F.when(F.col("x_l").isNotNull(), v).otherwise("top")})


_C = duckdb("vector") + """, c0 AS (SELECT page_number, box_id, l, t, r, b, CASE WHEN box_id % 5 <> 0 THEN l + box_id % 4 * 3 END AS xl, CASE WHEN box_id % 5 <> 0 THEN r - page_number % 3 * 4 END AS xr, CASE WHEN box_id % 5 <> 0 THEN t + box_id % 3 END AS xt, CASE WHEN box_id % 5 <> 0 THEN b - page_number % 2 * 2 END AS xb FROM vector),
c1 AS (SELECT *, greatest(xl - l, CAST(0 AS DOUBLE)) AS gl, greatest(r - xr, CAST(0 AS DOUBLE)) AS gr, greatest(xt - t, CAST(0 AS DOUBLE)) AS gt, greatest(b - xb, CAST(0 AS DOUBLE)) AS gb FROM c0),
c2 AS (SELECT *, CASE WHEN xl IS NULL THEN 'left' WHEN page_number % 10 = 0 THEN 'justify' WHEN abs(gl - gr) <= CAST(3.5 AS DOUBLE) AND least(gl, gr) >= CAST(0.5 AS DOUBLE) THEN 'center' WHEN gr + CAST(3.5 AS DOUBLE) < gl AND gr <= greatest(CAST(6 AS DOUBLE), (r - l) * CAST(0.2 AS DOUBLE)) THEN 'right' ELSE 'left' END AS horizontal,
  CASE WHEN xl IS NULL THEN 'top' WHEN abs(gt - gb) <= CAST(3.5 AS DOUBLE) THEN 'center' WHEN gb + CAST(3.5 AS DOUBLE) < gt AND gb <= greatest(CAST(6 AS DOUBLE), (b - t) * CAST(0.2 AS DOUBLE)) THEN 'bottom' ELSE 'top' END AS vertical FROM c1)"""


def cell_style(spark, sf_dir):
    out = styles.paddings(_cells(spark, sf_dir), ["page_number"], Box.of(names="ltrb"), Box.of("x_", names="ltrb"))
    return out.select("page_number", "box_id", "horizontal", "vertical", "pad_left", "pad_right", "pad_top", "pad_bottom")


_P = "least(greatest({}, CAST(0.5 AS DOUBLE)), CAST(12 AS DOUBLE))".format
CELL_STYLE = _C + f""", m AS (SELECT page_number, {_P("coalesce(median(CASE WHEN xl IS NOT NULL THEN least(gl, gr) END), CAST(3 AS DOUBLE))")} AS h, {_P("coalesce(median(CASE WHEN xl IS NOT NULL THEN least(gt, gb) END), CAST(2 AS DOUBLE))")} AS v FROM c2 GROUP BY page_number)
SELECT page_number, box_id, horizontal, vertical, CASE WHEN xl IS NOT NULL AND horizontal IN ('left', 'justify') THEN {_P("gl")} WHEN xl IS NOT NULL AND horizontal = 'center' THEN {_P("least(gl, gr)")} ELSE h END AS pad_left,
  CASE WHEN xl IS NOT NULL AND horizontal = 'right' THEN {_P("gr")} WHEN xl IS NOT NULL AND horizontal = 'center' THEN {_P("least(gl, gr)")} ELSE h END AS pad_right, CASE WHEN xl IS NOT NULL AND vertical = 'top' THEN {_P("gt")} WHEN xl IS NOT NULL AND vertical = 'center' THEN {_P("least(gt, gb)")} ELSE v END AS pad_top,
  CASE WHEN xl IS NOT NULL AND vertical = 'bottom' THEN {_P("gb")} WHEN xl IS NOT NULL AND vertical = 'center' THEN {_P("least(gt, gb)")} ELSE v END AS pad_bottom FROM c2 JOIN m USING (page_number)"""


def fixed_cell_alignment(spark, sf_dir):
    c = _cells(spark, sf_dir).where("x_l is not null")
    h, v = styles.fixed_alignment(Box.of(names="ltrb"), Box.of("x_", names="ltrb"))
    return c.select("page_number", "box_id", h.alias("horizontal"), v.alias("vertical"))


FIXED_CELL_ALIGNMENT = _C + """ SELECT page_number, box_id, CASE WHEN gl >= 4 AND gr >= 4 AND abs(gl - gr) <= 4 THEN 'center' WHEN gr <= 4 AND CASE WHEN gl > 0 THEN gl / greatest(gl + gr, CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END >= CAST(0.65 AS DOUBLE) THEN 'right' ELSE 'left' END AS horizontal,
  CASE WHEN abs(gt - gb) <= 3 THEN 'center' WHEN gt > gb + 3 THEN 'bottom' ELSE 'top' END AS vertical FROM c1 WHERE xl IS NOT NULL"""


def _drawings(spark, sf_dir):
    d = view(spark, sf_dir, "vector").select("page_number", F.col("box_id").alias("ordinal"), F.col("l").alias("d_l"), F.col("t").alias("d_t"), F.col("r").alias("d_r"), F.col("b").alias("d_b"), "fill_color", "stroke_color", "stroke_width")
    return d.withColumn("border", styles.border_candidate(Box.of("d_", names="ltrb"), F.col("stroke_color"), F.col("stroke_width"), F.col("fill_color"), F.col("fill_color") == "#FFFFFF"))


def table_borders(spark, sf_dir):
    """Borders of the tables that a page's boxes make, from the drawings that touch them."""
    t = view(spark, sf_dir, "vector").where("box_id % 2 = 0").select("page_number", F.col("box_id").alias("table_id"), "l", "t", "r", "b")
    return styles.table_borders(t, _drawings(spark, sf_dir), ["page_number"], "table_id", Box.of(names="ltrb"), Box.of("d_", names="ltrb"))


_DR = duckdb("vector") + """, d AS (SELECT page_number, box_id AS ordinal, l AS dl, t AS dt, r AS dr, b AS db, fill_color, CASE WHEN r > l AND b > t THEN CASE WHEN stroke_color IS NOT NULL AND stroke_width > 0 THEN CASE WHEN stroke_width <= 3 THEN stroke_color END
    WHEN fill_color IS NOT NULL AND greatest(r - l, b - t) / greatest(least(r - l, b - t), CAST(0.001 AS DOUBLE)) >= 4 AND least(r - l, b - t) <= 3 AND fill_color <> '#FFFFFF' THEN fill_color END END AS bc, CASE WHEN stroke_color IS NOT NULL AND stroke_width > 0 THEN stroke_width ELSE least(r - l, b - t) END AS bw FROM vector)"""
TABLE_BORDERS = _DR + """, tt AS (SELECT page_number, box_id AS table_id, l, t, r, b FROM vector WHERE box_id % 2 = 0),
h AS (SELECT tt.page_number, table_id, ordinal, bc, bw FROM tt JOIN d ON tt.page_number = d.page_number AND bc IS NOT NULL AND r + 2 >= dl AND dr >= l - 2 AND b + 2 >= dt AND db >= t - 2),
k AS (SELECT page_number, table_id, bc, count(*) AS n, min(ordinal) AS o FROM h GROUP BY ALL), m AS (SELECT page_number, table_id, arg_min(bc, {'n': -n, 'o': o}) AS c FROM k GROUP BY ALL), w AS (SELECT page_number, table_id, median(bw) AS w FROM h GROUP BY ALL)
SELECT page_number, table_id, coalesce(c, '#B7B7B7') AS border_color, least(greatest(coalesce(w, CAST(0.5 AS DOUBLE)), CAST(0.1 AS DOUBLE)), CAST(3 AS DOUBLE)) AS border_width FROM tt LEFT JOIN m USING (page_number, table_id) LEFT JOIN w USING (page_number, table_id)"""


def cell_fills(spark, sf_dir):
    c = view(spark, sf_dir, "vector").select("page_number", F.col("box_id").alias("cell"), (F.col("l") + 1).alias("l"), (F.col("t") + 1).alias("t"), (F.col("l") + 21).alias("r"), (F.col("t") + 9).alias("b"))
    return styles.cell_fills(c, _drawings(spark, sf_dir), ["page_number"], "cell", Box.of(names="ltrb"), Box.of("d_", names="ltrb"))


CELL_FILLS = _DR + """, c AS (SELECT page_number, box_id AS cell, l + 1 AS l, t + 1 AS t, l + 21 AS r, t + 9 AS b FROM vector),
h AS (SELECT c.page_number, cell, ordinal, fill_color, greatest(least(dr, r) - greatest(dl, l), CAST(0 AS DOUBLE)) * greatest(least(db, b) - greatest(dt, t), CAST(0 AS DOUBLE)) / greatest((r - l) * (b - t), CAST(1 AS DOUBLE)) AS s FROM c JOIN d ON c.page_number = d.page_number AND fill_color IS NOT NULL AND least(dr - dl, db - dt) > 3)
SELECT page_number, cell, nullif(arg_min(fill_color, {'s': -s, 'o': ordinal}), '#FFFFFF') AS fill FROM h WHERE s >= CAST(0.7 AS DOUBLE) GROUP BY ALL"""


def header_rows(spark, sf_dir):
    """Header evidence of tables made of an order's lines; the first row is the least line number."""
    l = view(spark, sf_dir, "lineitem")  # noqa: E741
    c = l.select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"), F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.col("l_returnflag")).alias("text"), F.when(F.col("l_linenumber") <= 2, 9).otherwise(F.col("l_partkey") % 3).alias("bold_chars"),
        F.lit(10).alias("chars"), F.when(F.col("l_suppkey") % 2 == 0, "#EEEEEE").alias("fill"), (F.lit(9.0) + F.col("l_linenumber") % 3).alias("font_size"))
    return styles.header_rows(c, ["table_id"])


def _hdr(side: str, name: str) -> str:
    return f"""count_if({side}) AS {name}n, sum(CASE WHEN {side} THEN bold END) / CAST(greatest(sum(CASE WHEN {side} THEN 10 END), 1) AS DOUBLE) AS {name}bold, avg(CASE WHEN {side} AND txt <> '' THEN CASE WHEN bold / CAST(10 AS DOUBLE) >= CAST(0.6 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS {name}cells,
  avg(CASE WHEN {side} THEN CASE WHEN fl THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS {name}fill, median(CASE WHEN {side} THEN fs END) AS {name}font, avg(CASE WHEN {side} THEN CASE WHEN txt <> '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS {name}text"""


HEADER_ROWS = f"""WITH c AS (SELECT l_orderkey AS table_id, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE l_returnflag END AS txt, CASE WHEN l_linenumber <= 2 THEN 9 ELSE l_partkey % 3 END AS bold, l_suppkey % 2 = 0 AS fl, CAST(9 AS DOUBLE) + l_linenumber % 3 AS fs, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lineitem),
g AS (SELECT table_id, {_hdr('first', 'a')}, {_hdr('NOT first', 'b')} FROM c GROUP BY table_id),
z AS (SELECT table_id, an, bn, coalesce(atext, 0) AS atext, coalesce(abold, 0) AS abold, coalesce(bbold, 0) AS bbold, coalesce(acells, 0) AS acells, coalesce(bcells, 0) AS bcells, coalesce(afill, 0) AS afill, coalesce(bfill, 0) AS bfill, coalesce(afont, 0) AS afont, coalesce(bfont, 0) AS bfont FROM g),
y AS (SELECT table_id, an > 0 AND bn > 0 AND atext >= CAST(0.5 AS DOUBLE) AS ok, CAST(0.1 AS DOUBLE) + CASE WHEN abold >= CAST(0.6 AS DOUBLE) AND acells >= CAST(0.75 AS DOUBLE) AND abold - bbold >= CAST(0.25 AS DOUBLE) AND acells - bcells >= CAST(0.25 AS DOUBLE) THEN CAST(0.45 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN afill >= CAST(0.5 AS DOUBLE) AND afill - bfill >= CAST(0.25 AS DOUBLE) THEN CAST(0.45 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN afont > 0 AND bfont > 0 AND afont - bfont >= CAST(0.5 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN atext >= CAST(0.9 AS DOUBLE) THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS s FROM z)
SELECT table_id, CASE WHEN ok THEN s ELSE CAST(0 AS DOUBLE) END AS score, ok AND s >= CAST(0.55 AS DOUBLE) AS is_header FROM y"""


def column_widths(spark, sf_dir):
    l = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_partkey").alias("column"), (F.col("l_quantity") * 4 - 3).alias("width"))  # noqa: E741
    return styles.column_widths(l, ["table_id"], 200.0)


COLUMN_WIDTHS = """WITH c AS (SELECT l_orderkey AS table_id, l_partkey AS "column", l_quantity * 4 - 3 AS width, greatest(l_quantity * 4 - 3, CAST(6 AS DOUBLE)) AS s FROM lineitem),
d AS (SELECT *, greatest(s * (least(greatest(sum(s) OVER w, CAST(36 AS DOUBLE)), CAST(200 AS DOUBLE)) / sum(s) OVER w), CAST(6 AS DOUBLE)) AS x FROM c WINDOW w AS (PARTITION BY table_id))
SELECT table_id, "column", width, CASE WHEN sum(x) OVER v > 200 THEN greatest(x * (CAST(200 AS DOUBLE) / sum(x) OVER v), CAST(1 AS DOUBLE)) ELSE x END AS word_width FROM d WINDOW v AS (PARTITION BY table_id)"""


def merged_segments(spark, sf_dir):
    """Horizontal edges of a page's boxes, on a raster of 40 points, joined where they meet."""
    s = view(spark, sf_dir, "box").select("page_number", F.col("l").alias("start"), F.col("r").alias("end"), (F.floor(F.col("t") / 40) * 40).cast("double").alias("at"))
    return styles.merged_segments(dealt(spark, sf_dir, s, "page_number"), ["page_number"]).select("page_number", "start", "end", "at")


MERGED_SEGMENTS = duckdb("box") + """, s AS (SELECT page_number, l AS a, r AS z, CAST(floor(t / 40) * 40 AS DOUBLE) AS p FROM box), g AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY page_number, p ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + CAST(0.5 AS DOUBLE) THEN 0 ELSE 1 END AS nw FROM s),
k AS (SELECT *, sum(nw) OVER (PARTITION BY page_number, p ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT page_number, min(a) AS start, max(z) AS "end", p AS "at" FROM k GROUP BY page_number, p, grp"""


def estimated_columns(spark, sf_dir):
    b = view(spark, sf_dir, "vector").select("page_number", F.lit("twenty characters and more").alias("text"), F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    return styles.estimated_columns(b, ["page_number"], 612.0)


ESTIMATED_COLUMNS = duckdb("vector") + """, f AS (SELECT page_number, l, t, r, b, (l + r) / 2 AS c FROM vector WHERE r - l <= CAST(612 AS DOUBLE) * CAST(0.72 AS DOUBLE)),
g AS (SELECT *, row_number() OVER w AS k, lead(c) OVER w - c AS gap, count(*) OVER (PARTITION BY page_number) AS n FROM f WINDOW w AS (PARTITION BY page_number ORDER BY c, t, l)),
h AS (SELECT page_number, max(gap) AS gap, arg_min(k, {'g': -coalesce(gap, CAST(-1 AS DOUBLE)), 'k': k}) AS cut FROM g GROUP BY page_number),
i AS (SELECT g.page_number, max(h.gap) AS gap, max(n) AS n, count_if(k <= cut) AS ln, count_if(k > cut) AS rn, median(CASE WHEN k <= cut THEN r END) AS lr, median(CASE WHEN k > cut THEN l END) AS rl, min(CASE WHEN k <= cut THEN t END) AS lt, max(CASE WHEN k <= cut THEN b END) AS lb, min(CASE WHEN k > cut THEN t END) AS rt, max(CASE WHEN k > cut THEN b END) AS rb FROM g JOIN h USING (page_number) GROUP BY g.page_number),
p AS (SELECT DISTINCT page_number FROM vector)
SELECT page_number, CASE WHEN coalesce(n >= 4 AND gap >= CAST(612 AS DOUBLE) * CAST(0.14 AS DOUBLE) AND ln >= 2 AND rn >= 2 AND lr < rl AND greatest(least(lb, rb) - greatest(lt, rt), CAST(0 AS DOUBLE)) / greatest(least(lb - lt, rb - rt), CAST(1 AS DOUBLE)) >= CAST(0.2 AS DOUBLE), false) THEN 2 ELSE 1 END AS column_count FROM p LEFT JOIN i USING (page_number)"""


def wrapper_rows(spark, sf_dir):
    """Rows of an order's lines without the wide single cells at its head and tail."""
    l = view(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row")).distinct()  # noqa: E741
    return styles.without_wrappers(l, ["l_orderkey"], "row", (F.col("l_orderkey") + F.col("row")) % 3 != 0)


WRAPPER_ROWS = """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS row, (l_orderkey + l_linenumber) % 3 <> 0 AS x FROM lineitem), g AS (SELECT *, min(CASE WHEN NOT x THEN row END) OVER w AS lo, max(CASE WHEN NOT x THEN row END) OVER w AS hi, max(row) OVER w AS last FROM r WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, row FROM g WHERE (lo IS NULL AND row = last) OR row BETWEEN lo AND hi"""


def numbering_definitions(spark, sf_dir, runs_=None):
    """Level definitions of the list runs of the line view, or of runs_ where these are given; levels by arithmetic on the line."""
    if runs_ is None:
        runs_ = lists.sequences(L._items(spark, sf_dir), ["doc_id", "page_number"], ["line_index"])
    items = runs_.where("run is not null").withColumns({"level": (F.col("line_index") % 3).cast("int"), "indent": F.col("left"), "run": F.col("run").cast("long")})
    return numbering.definitions(items, ["doc_id", "page_number", "run"], "line_index", 60.0)


_DEF = L._RUNS + """, it AS (SELECT doc_id, page_number, CAST(run AS BIGINT) AS run, line_index, line_index % 3 AS level, list_type, kind, marker, number, greatest(l - 60, CAST(0 AS DOUBLE)) AS ind FROM u WHERE run IS NOT NULL),
kn AS (SELECT doc_id, page_number, run, level, kind, count(*) AS n, min(line_index) AS o FROM it WHERE kind <> 'unknown' GROUP BY ALL), kk AS (SELECT doc_id, page_number, run, level, arg_min(kind, {'n': -n, 'o': o}) AS kind FROM kn GROUP BY ALL),
pr AS (SELECT doc_id, page_number, run, level, arg_min(list_type, line_index) AS list_type, arg_min(marker, line_index) AS marker, median(ind) AS i, arg_min({'n': number}, line_index).n AS fn FROM it GROUP BY ALL),
df AS (SELECT pr.doc_id, pr.page_number, pr.run, CAST(pr.level AS INT) AS level, list_type, marker, fn, coalesce(kk.kind, CASE WHEN list_type = 'bullet' THEN 'bullet' ELSE ['decimal', 'lower_alpha', 'lower_roman', 'upper_alpha', 'upper_roman'][pr.level % 5 + 1] END) AS kind, CAST(greatest(CAST(round_even(i * 20, 0) AS INT), pr.level * 360 + 720) AS INT) AS lt FROM pr LEFT JOIN kk USING (doc_id, page_number, run, level)),
dg AS (SELECT *, CASE WHEN kind = 'multilevel_decimal' THEN array_to_string(list_transform(generate_series(1, level + 1), lambda k: '%' || k), '.') ELSE '%' || (level + 1) END AS body FROM df)"""
NUMBERING_DEFINITIONS = _DEF + f""" SELECT doc_id, page_number, run, level, kind, CASE WHEN list_type = 'bullet' THEN 'bullet' ELSE CASE kind WHEN 'lower_alpha' THEN 'lowerLetter' WHEN 'upper_alpha' THEN 'upperLetter' WHEN 'lower_roman' THEN 'lowerRoman' WHEN 'upper_roman' THEN 'upperRoman' ELSE 'decimal' END END AS format,
  CASE WHEN list_type = 'bullet' THEN CASE WHEN length(marker) = 1 THEN marker ELSE substr('{numbering.BULLET_BY_LEVEL}', level % 9 + 1, 1) END WHEN marker LIKE '(%)' THEN '(' || body || ')' WHEN marker LIKE '%)' THEN body || ')' ELSE body || '.' END AS text,
  lt AS left_twips, least(360, greatest(lt // 2, 240)) AS hanging_twips, CAST(CASE WHEN list_type <> 'number' THEN 1 WHEN level = 0 THEN greatest(coalesce(fn, 1), 1) WHEN fn > 1 THEN fn ELSE 1 END AS INT) AS start FROM dg"""


def shared_definitions(spark, sf_dir):
    """How many runs share each set of definitions (hash of a nested value; no SQL form)."""
    s = numbering.shared(numbering_definitions(spark, sf_dir), ["doc_id", "page_number", "run"])
    return s.groupBy("abstract").agg(F.count("*").alias("runs")).select("abstract.*", "runs")


def styled_runs(spark, sf_dir):
    """Runs of lines whose words are spans with styles by arithmetic (ordered fold; no SQL form)."""
    l = view(spark, sf_dir, "line")  # noqa: E741
    w = l.select("doc_id", "line_index", "font_size", F.posexplode(F.split("text", " ")).alias("k", "text"))
    s = w.select("doc_id", "line_index", (F.col("k") * 30.0).alias("left"), (F.col("k") * 30.0 + 28 + F.col("k") % 3).alias("right"), "text", F.lit("Arial").alias("font"), "font_size", (F.floor(F.col("k") / 4) % 2 == 1).alias("bold"), F.lit(False).alias("italic"), F.lit(0).alias("color"))
    r = runs.line_runs(s, ["doc_id", "line_index"])
    return r.select("doc_id", "line_index", F.size("runs").alias("n_runs"), F.array_join(F.transform("runs", lambda x: x["text"]), "|").alias("text"))


def flowing_text(spark, sf_dir):
    """Lines of three as flowing text."""
    l = view(spark, sf_dir, "line")  # noqa: E741
    lines = l.select("doc_id", F.floor(F.col("line_index") / 3).cast("int").alias("paragraph"), "line_index", "text", F.col("l").alias("left"), F.col("r").alias("right"))
    return runs.flow(lines, ["doc_id", "paragraph"], ["line_index"])


FLOWING_TEXT = duckdb("line") + """, x AS (SELECT doc_id, CAST(floor(line_index / 3) AS INT) AS paragraph, row_number() OVER (PARTITION BY doc_id, floor(line_index / 3) ORDER BY line_index) AS k, trim(text) AS t, (r - min(l) OVER w) / greatest(max(r) OVER w - min(l) OVER w, CAST(1 AS DOUBLE)) AS f FROM line WINDOW w AS (PARTITION BY doc_id, floor(line_index / 3))),
a AS (SELECT doc_id, paragraph, t AS t1, f AS f1 FROM x WHERE k = 1), b AS (SELECT a.*, x.t, x.f FROM a LEFT JOIN x ON a.doc_id = x.doc_id AND a.paragraph = x.paragraph AND x.k = 2), b2 AS (SELECT doc_id, paragraph, {j1} AS t1, coalesce(f, f1) AS f1 FROM b),
c AS (SELECT b2.*, x.t, x.f FROM b2 LEFT JOIN x ON b2.doc_id = x.doc_id AND b2.paragraph = x.paragraph AND x.k = 3) SELECT doc_id, paragraph, {j1} AS text FROM c""".replace("{j1}", """CASE WHEN t IS NULL THEN t1 WHEN regexp_matches(t, '^[a-z](\\s|$)') AND length(regexp_extract(t1, '([A-Za-z]+)$', 1)) >= 3 AND lower(regexp_extract(t1, '([A-Za-z]+)$', 1)) NOT IN (""" + ", ".join(f"'{w}'" for w in runs.WHOLE_WORDS) + """) AND f1 >= CAST(0.8 AS DOUBLE)
  THEN t1 || left(t, 1) || CASE WHEN trim(substr(t, 2)) = '' THEN '' ELSE ' ' || trim(substr(t, 2)) END WHEN left(t, 1) IN ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}') OR t1 LIKE '%-' THEN t1 || t ELSE t1 || ' ' || t END""")


def page_fields(spark, sf_dir):
    """Page number fields and band signatures of texts built from orders."""
    o = view(spark, sf_dir, "orders")
    forms = F.array(F.concat(F.lit("Page "), F.col("o_orderkey")), F.concat(F.lit(" "), F.col("o_custkey"), F.lit(" of "), F.col("o_orderkey")), F.concat(F.col("o_orderpriority"), F.lit(" 12/34: "), F.col("o_orderstatus")), F.lit("iv / xii"), F.lit("a"))
    t = F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int"))
    p = X.page_field(F.col("t"))
    return o.select("o_orderkey", t.alias("t")).select("o_orderkey", p["prefix"].alias("prefix"), p["separator"].alias("separator"), p["has_total"].alias("has_total"), X.signature("t").alias("signature"))


PAGE_FIELDS = """WITH x AS (SELECT o_orderkey, ['Page ' || o_orderkey, ' ' || o_custkey || ' of ' || o_orderkey, o_orderpriority || ' 12/34: ' || o_orderstatus, 'iv / xii', 'a'][o_orderkey % 5 + 1] AS t FROM orders),
y AS (SELECT *, regexp_matches(lower(trim(t)), '^(page\\s*)?\\d+(\\s*(of|/)\\s*\\d+)?\\s*$') AS f, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS lt FROM x),
z AS (SELECT *, trim(regexp_replace(regexp_replace(lt, '\\d+(?:[.,:/-]\\d+)*', '<n>', 'g'), '[^\\p{L}\\p{N}_<>]+', ' ', 'g')) AS nt FROM y)
SELECT o_orderkey, CASE WHEN f THEN regexp_extract(trim(t), '^([Pp]age\\s*)?(\\d+)', 1) END AS prefix, CASE WHEN f THEN regexp_extract(trim(t), '^(?:[Pp]age\\s*)?\\d+(\\s*(?:of|/)\\s*)\\d+', 1) END AS separator, CASE WHEN f THEN regexp_matches(trim(t), '(of|/)') END AS has_total,
  CASE WHEN lt = '' THEN '' WHEN regexp_matches(lt, '^(?:page\\s*)?(?:\\d+|[ivxlcdm]+)(?:\\s*(?:of|/)\\s*(?:\\d+|[ivxlcdm]+))?$') THEN '__page_number__' WHEN length(nt) < 2 THEN '' ELSE nt END AS signature FROM z"""

QUERIES = {
    "cell_style": cell_style, "fixed_cell_alignment": fixed_cell_alignment, "table_borders": table_borders, "cell_fills": cell_fills, "header_rows": header_rows, "column_widths": column_widths, "merged_segments": merged_segments, "estimated_columns": estimated_columns,
    "wrapper_rows": wrapper_rows, "numbering_definitions": numbering_definitions, "shared_definitions": shared_definitions, "styled_runs": styled_runs, "flowing_text": flowing_text, "page_fields": page_fields}
SQL = {
    "cell_style": CELL_STYLE, "fixed_cell_alignment": FIXED_CELL_ALIGNMENT, "table_borders": TABLE_BORDERS, "cell_fills": CELL_FILLS, "header_rows": HEADER_ROWS, "column_widths": COLUMN_WIDTHS, "merged_segments": MERGED_SEGMENTS, "estimated_columns": ESTIMATED_COLUMNS,
    "wrapper_rows": WRAPPER_ROWS, "numbering_definitions": NUMBERING_DEFINITIONS, "flowing_text": FLOWING_TEXT, "page_fields": PAGE_FIELDS}
