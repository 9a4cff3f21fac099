"""Queries over the line view: markers, lists, fonts, text and number functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelattice.functions import numbers as N
from pagelattice.functions import text as X
from pagelattice.operators import lists, paragraphs
from pagelattice.operators.fonts import font_statistics
from pagelattice.sources.bridge import duckdb, view

_B = X.BULLETS
_SPACE = r"[\s\x{00A0}]"
_DUCK_MARK = f"""coalesce(nullif(regexp_extract(text, '^\\s*([{_B}])(?:\\s+|$)', 1), ''),
  nullif(regexp_extract(text, '^\\s*(\\(\\s*(?:\\d+(?:\\.\\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]+)\\s*\\)|(?:\\d+(?:\\.\\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)])(?:\\s+|$)', 1), ''))"""
_DUCK_VALUE = """CASE WHEN marker LIKE '(%)' THEN trim(regexp_replace(regexp_replace(marker, '^\\(', ''), '\\)$', '')) ELSE regexp_replace(marker, '[.)]+$', '') END"""
_MARKED = duckdb("line") + f""", m AS (SELECT *, {_DUCK_MARK} AS marker FROM line), v AS (SELECT *, {_DUCK_VALUE} AS value FROM m),
k AS (SELECT *, CASE WHEN marker IS NULL THEN NULL WHEN regexp_matches(marker, '^[{_B}]$') THEN 'bullet' WHEN regexp_matches(value, '^\\d+(\\.\\d+)+$') THEN 'multilevel_decimal'
  WHEN regexp_matches(value, '^\\d+$') THEN 'decimal' WHEN regexp_matches(value, '^[ivxlcdmIVXLCDM]+$') THEN CASE WHEN value = upper(value) THEN 'upper_roman' ELSE 'lower_roman' END
  WHEN regexp_matches(value, '^[A-Za-z]$') THEN CASE WHEN value = upper(value) THEN 'upper_alpha' ELSE 'lower_alpha' END ELSE 'unknown' END AS kind FROM v),
r AS (SELECT *, lower(value) AS lv FROM k),
n AS (SELECT *, CASE WHEN regexp_matches(value, '^\\d+$') THEN TRY_CAST(value AS INT) WHEN regexp_matches(value, '^[A-Za-z]$') THEN CAST(ascii(lv) - 96 AS INT)
  WHEN regexp_matches(value, '^[ivxlcdmIVXLCDM]+$') THEN CAST(list_sum(list_transform(generate_series(1, length(lv)), lambda i:
      CASE WHEN len(list_filter(generate_series(i + 1, length(lv)), lambda j: strpos('ivxlcdm', substr(lv, j, 1)) > strpos('ivxlcdm', substr(lv, i, 1)))) > 0 THEN -1 ELSE 1 END
      * [1, 5, 10, 50, 100, 500, 1000][strpos('ivxlcdm', substr(lv, i, 1))])) AS INT) END AS number,
  CASE WHEN kind = 'multilevel_decimal' THEN least(len(string_split(value, '.')) - 1, 8) ELSE 0 END AS explicit_level,
  CASE WHEN kind = 'bullet' THEN 'bullet' WHEN kind IS NOT NULL THEN 'number' END AS list_type FROM r)"""


def _items(spark, sf_dir):
    line = view(spark, sf_dir, "line").select("doc_id", "page_number", "line_index", "text", "font_size", F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    return lists.items(line)


def line_marker_kinds(spark, sf_dir):
    return _items(spark, sf_dir).select("doc_id", "line_index", "marker", F.col("kind").alias("marker_kind"), "list_type")


LINE_MARKER_KINDS = _MARKED + " SELECT doc_id, line_index, marker, kind AS marker_kind, list_type FROM n"


def marker_values(spark, sf_dir):
    m = F.col("marker")
    return _items(spark, sf_dir).where("marker is not null").select(
        "doc_id", "line_index", X.marker_value_text(m).alias("value"), F.col("number").cast("int").alias("number"), F.array_join(X.marker_levels(m).cast("array<string>"), "/").alias("parts"),
        F.col("explicit_level").cast("int").alias("explicit_level"), X.list_start(m).cast("int").alias("list_start"))


MARKER_VALUES = _MARKED + """ SELECT doc_id, line_index, value, number, CASE WHEN kind = 'multilevel_decimal' THEN array_to_string(list_transform(string_split(value, '.'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), '/') END AS parts,
  CAST(explicit_level AS INT) AS explicit_level, greatest(coalesce(TRY_CAST(nullif(regexp_extract(marker, '^\\s*(\\d+)', 1), '') AS INT), 1), 1) AS list_start FROM n WHERE marker IS NOT NULL"""

_KEYS, _ORDER = ["doc_id", "page_number"], ["line_index"]


def list_sequences(spark, sf_dir):
    """Sequences of list items per page, with restarts split, their start values and confidence."""
    runs = lists.sequences(_items(spark, sf_dir), _KEYS, _ORDER)
    return lists.summaries(lists.restarts(runs, _KEYS, _ORDER), _KEYS, _ORDER)


_RUNS = _MARKED + """, g AS (SELECT *, lag(list_type) OVER w AS pt, lag(b) OVER w AS pb, lag(greatest(b - t, CAST(1 AS DOUBLE))) OVER w AS ph, greatest(b - t, CAST(1 AS DOUBLE)) AS h FROM n WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_index)),
h AS (SELECT *, CASE WHEN list_type IS NOT NULL THEN CASE WHEN coalesce(list_type = pt AND greatest(t - pb, CAST(0 AS DOUBLE)) <= greatest(CAST(36 AS DOUBLE), greatest(h, ph) * 3), false) THEN 0 ELSE 1 END END AS nw FROM g),
u AS (SELECT *, CASE WHEN list_type IS NOT NULL THEN sum(nw) OVER (PARTITION BY doc_id, page_number ORDER BY line_index) END AS run FROM h),
p AS (SELECT *, coalesce(abs(l - min(l) OVER (PARTITION BY doc_id, page_number, run)) <= 8 AND list_type = 'number', false) AS top FROM u),
q AS (SELECT *, last_value(CASE WHEN top THEN {'number': number} END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number, run ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM p),
s AS (SELECT *, CASE WHEN run IS NOT NULL THEN sum(CASE WHEN coalesce(top AND number = 1 AND lt.number >= 1, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, run ORDER BY line_index) END AS part FROM q)"""
LIST_SEQUENCES = _RUNS + """, z AS (SELECT doc_id, page_number, run, part, arg_min(list_type, line_index) AS list_type, count(*) AS items, arg_min({'n': number}, line_index).n AS f, avg(CASE WHEN kind = 'bullet' THEN CAST(0.96 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END) AS confidence, min(line_index) AS pos
  FROM s WHERE run IS NOT NULL GROUP BY doc_id, page_number, run, part)
SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS INT) AS sequence_id, list_type, items, greatest(coalesce(f, 1), 1) AS start_at, confidence FROM z"""


def numbering_restarts(spark, sf_dir):
    runs = lists.sequences(_items(spark, sf_dir), _KEYS, _ORDER)
    return lists.restarts(runs, _KEYS, _ORDER).where("run is not null").select("doc_id", "line_index", F.col("run").cast("long"), F.col("part").cast("long"))


NUMBERING_RESTARTS = _RUNS + " SELECT doc_id, line_index, CAST(run AS BIGINT) AS run, CAST(part AS BIGINT) AS part FROM s WHERE run IS NOT NULL"


def indent_levels(spark, sf_dir):
    """Level of each list item, from indent clusters and marker depth (ordered fold; no SQL form)."""
    runs = lists.restarts(lists.sequences(_items(spark, sf_dir), _KEYS, _ORDER), _KEYS, _ORDER)
    return lists.levels(runs, _KEYS, 468.0).where("run is not null").select("doc_id", "line_index", "level")


def font_stats(spark, sf_dir):
    return font_statistics(view(spark, sf_dir, "line"), ["doc_id"], "font_size", ["line_index"])


FONT_STATS = duckdb("line") + """, c AS (SELECT doc_id, round(font_size, 1) AS s, count(*) AS n, min(line_index) AS pos FROM line GROUP BY doc_id, round(font_size, 1))
SELECT doc_id, max(s) AS largest, min(s) AS smallest, arg_min(s, {'n': -n, 'pos': pos}) AS most_common FROM c GROUP BY doc_id"""


def block_classes(spark, sf_dir):
    """Page numbers, headings and paragraphs, by text and by font size against the document's mode."""
    line = view(spark, sf_dir, "line")
    text = X.strip("text")
    kind = F.when(text == "", "unknown").when(text.rlike(r"(?U)^\d+$"), "page_number").otherwise("paragraph")
    mode = font_statistics(line, ["doc_id"], "font_size", ["line_index"]).select("doc_id", "most_common")
    return line.join(mode, "doc_id").select("doc_id", "line_index", kind.alias("block_type"), (F.col("font_size") >= F.col("most_common") * F.lit(1.1)).alias("is_heading_candidate"))


BLOCK_CLASSES = duckdb("line") + """, c AS (SELECT doc_id, round(font_size, 1) AS s, count(*) AS n, min(line_index) AS pos FROM line GROUP BY doc_id, round(font_size, 1)),
m AS (SELECT doc_id, arg_min(s, {'n': -n, 'pos': pos}) AS mode FROM c GROUP BY doc_id)
SELECT line.doc_id, line_index, CASE WHEN trim(text) = '' THEN 'unknown' WHEN regexp_matches(trim(text), '^\\d+$') THEN 'page_number' ELSE 'paragraph' END AS block_type,
  font_size >= mode * CAST(1.1 AS DOUBLE) AS is_heading_candidate FROM line JOIN m USING (doc_id)"""


def text_normalize(spark, sf_dir):
    t = F.col("text")
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_index"))
    return view(spark, sf_dir, "line").withColumn("next", F.coalesce(following, F.lit(""))).select(
        "doc_id", "line_index", X.inline_text(t).alias("inline"), X.contains_bullet(t).alias("has_bullet"), X.is_bullet_only(t).alias("bullet_only"),
        X.needs_blank(t, F.col("next"), F.col("font_size") - 10, F.col("font_size")).alias("blank"), X.needs_boundary_blank(t, F.col("next")).alias("boundary_blank"))


TEXT_NORMALIZE = duckdb("line") + f""", x AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY line_index), '') AS nx FROM line),
y AS (SELECT *, substr(nx, 1, 1) IN ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}') AS nb, right(text, 1) IN ('(', '[', '{{', '/', chr(92), '–', '—') AS na FROM x)
SELECT doc_id, line_index, regexp_replace(regexp_replace(text, '[\\t\\r\\n\\f\\v]+', ' ', 'g'), ' {{2,}}', ' ', 'g') AS inline, regexp_matches(text, '[{X.PLAIN_BULLETS}]') AS has_bullet,
  regexp_matches(trim(text), '^[{X.PLAIN_BULLETS}]$') AS bullet_only,
  CASE WHEN text = '' OR nx = '' THEN false WHEN regexp_matches(text, '\\s$') OR regexp_matches(nx, '^\\s') THEN true WHEN nb OR na THEN false
    ELSE font_size - 10 > 0 AND font_size - 10 >= greatest(CAST(0.5 AS DOUBLE), greatest(font_size, CAST(1 AS DOUBLE)) * CAST(0.04 AS DOUBLE)) END AS blank,
  CASE WHEN text = '' OR nx = '' THEN false WHEN regexp_matches(text, '\\s$') OR regexp_matches(nx, '^\\s') THEN false ELSE NOT (nb OR na OR right(text, 1) = '-') END AS boundary_blank FROM y"""


def font_names(spark, sf_dir):
    """Font families of names built from part brands and types."""
    forms = ["ABCDEF+HelveticaNeue-Bold", "Times-Italic", "DMSans-SemiBold", "MyOwn_FontFace-BoldItalic", "Open Sans,Bold", "", "CourierNewPSMT", "plainFace"]
    name = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return view(spark, sf_dir, "part").select("p_partkey", name.alias("font")).select("p_partkey", "font", X.font_family("font").alias("family"))


FONT_NAMES = """SELECT p_partkey, ['ABCDEF+HelveticaNeue-Bold', 'Times-Italic', 'DMSans-SemiBold', 'MyOwn_FontFace-BoldItalic', 'Open Sans,Bold', '', 'CourierNewPSMT', 'plainFace'][p_partkey % 8 + 1] AS font,
  ['Arial', 'Times New Roman', 'DM Sans', 'My Own Font Face', 'Open Sans', 'Arial', 'Courier New', 'plain Face'][p_partkey % 8 + 1] AS family FROM part"""


def color_and_units(spark, sf_dir):
    """Colours, sizes and units from part keys, sizes and prices."""
    p = view(spark, sf_dir, "part")
    packed = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    part = lambda k: (F.col("p_partkey") * k % 256).cast("double") / 255.0
    width, height = (F.col("p_size") * 20 + 400).cast("double"), (F.col("p_partkey") % 60 * 10 + 500).cast("double")
    size = F.col("p_size").cast("double") * 0.37
    return p.select(
        "p_partkey", N.hex_of_rgb(N.rgb(packed)).alias("hex"), N.hex_of_unit(part(3), part(5), part(7)).alias("unit_hex"), N.is_nearly_white(part(3), part(5), part(7)).alias("white"),
        N.border_color(N.hex_of_rgb(N.rgb(packed))).alias("border"), N.half_points(size).alias("half_points"), N.word_font_size(size).alias("word_size"),
        N.twips(F.col("p_size").cast("double") * 0.6).alias("twips"), N.orientation(width, height).alias("orientation"), N.dimension_matches(width, height).alias("square"),
        N.is_bold(F.col("p_size")).alias("bold"), N.is_italic(F.col("p_size"), F.col("p_type")).alias("italic"))


COLOR_AND_UNITS = """WITH p AS (SELECT *, CAST(p_partkey * 7919 % 16777216 AS INT) AS k, CAST(p_partkey * 3 % 256 AS DOUBLE) / 255 AS x, CAST(p_partkey * 5 % 256 AS DOUBLE) / 255 AS y, CAST(p_partkey * 7 % 256 AS DOUBLE) / 255 AS z,
  CAST(p_size * 20 + 400 AS DOUBLE) AS w, CAST(p_partkey % 60 * 10 + 500 AS DOUBLE) AS h, CAST(p_size AS DOUBLE) * CAST(0.37 AS DOUBLE) AS s FROM part)
SELECT p_partkey, printf('#%02X%02X%02X', k >> 16, (k >> 8) & 255, k & 255) AS hex, printf('#%02X%02X%02X', CAST(round_even(x * 255, 0) AS INT), CAST(round_even(y * 255, 0) AS INT), CAST(round_even(z * 255, 0) AS INT)) AS unit_hex,
  x >= CAST(0.95 AS DOUBLE) AND y >= CAST(0.95 AS DOUBLE) AND z >= CAST(0.95 AS DOUBLE) AS white, printf('%02X%02X%02X', k >> 16, (k >> 8) & 255, k & 255) AS border,
  CAST(greatest(floor(greatest(s, CAST(0.5 AS DOUBLE)) * 2 + CAST(0.5 AS DOUBLE)), 1) AS INT) AS half_points, floor(greatest(s, CAST(0.5 AS DOUBLE)) * 2 + CAST(0.5 AS DOUBLE)) / CAST(2 AS DOUBLE) AS word_size,
  CAST(greatest(round_even(CAST(p_size AS DOUBLE) * CAST(0.6 AS DOUBLE) * 20, 0), 0) AS INT) AS twips,
  CASE WHEN abs(w - h) / greatest(w, h, CAST(1 AS DOUBLE)) <= CAST(0.03 AS DOUBLE) THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation,
  abs(w - h) <= greatest(CAST(1 AS DOUBLE), greatest(abs(w), abs(h)) * CAST(0.002 AS DOUBLE)) AS square, p_size & 16 <> 0 AS bold, p_size & 2 <> 0 OR regexp_matches(lower(p_type), 'italic|oblique') AS italic FROM p"""

def standalone_markers(spark, sf_dir):
    """Rows that are only a marker, and the rows they are attached to; every ninth text is cut to its marker."""
    i = _items(spark, sf_dir)
    cut = F.when((F.col("line_index") % 4 == 1) & F.col("marker").isNotNull(), F.col("marker")).otherwise(F.col("text"))
    i = i.withColumns({"text": cut, "right": F.when(cut == F.col("marker"), F.col("left") + 8).otherwise(F.col("right")), "top": F.col("top") - F.when(F.col("line_index") % 4 == 2, 14.0).otherwise(0.0), "bottom": F.col("bottom") - F.when(F.col("line_index") % 4 == 2, 14.0).otherwise(0.0), "left": F.col("left") + F.when(F.col("line_index") % 4 == 2, 30.0).otherwise(0.0)})
    i = i.withColumn("list_type", F.when(F.col("line_index") % 4 != 2, F.col("list_type")))
    out = lists.attach_standalone(i, _KEYS, _ORDER)
    return out.where("marker_only or attached_marker is not null").select("doc_id", "line_index", "marker_only", "attached_marker")


STANDALONE_MARKERS = _MARKED + """, sa AS (SELECT doc_id, page_number, line_index, marker, CASE WHEN line_index % 4 = 1 AND marker IS NOT NULL THEN marker ELSE text END AS text, l + CASE WHEN line_index % 4 = 2 THEN CAST(30 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS l, t - CASE WHEN line_index % 4 = 2 THEN CAST(14 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS t,
  CASE WHEN (CASE WHEN line_index % 4 = 1 AND marker IS NOT NULL THEN marker ELSE text END) = marker THEN l + 8 ELSE r END AS r, b - CASE WHEN line_index % 4 = 2 THEN CAST(14 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS b, CASE WHEN line_index % 4 <> 2 THEN list_type END AS list_type FROM n),
sb AS (SELECT *, lead(l) OVER w AS nl, lead(t) OVER w AS nt, lead(b) OVER w AS nb, lead(text) OVER w AS nx, lead(list_type) OVER w AS ny FROM sa WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_index)),
sc AS (SELECT *, coalesce(marker IS NOT NULL AND trim(text) = marker AND ny IS NULL AND trim(nx) <> '' AND nl > l AND nl - r BETWEEN -2 AND 72 AND (greatest(least(b, nb) - greatest(t, nt), CAST(0 AS DOUBLE)) / least(greatest(b - t, CAST(1 AS DOUBLE)), greatest(nb - nt, CAST(1 AS DOUBLE))) >= CAST(0.45 AS DOUBLE) OR abs((t + b) / 2 - (nt + nb) / 2) <= 8), false) AS marker_only FROM sb),
sd AS (SELECT *, CASE WHEN lag(marker_only) OVER w THEN lag(marker) OVER w END AS attached_marker FROM sc WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_index))
SELECT doc_id, line_index, marker_only, attached_marker FROM sd WHERE marker_only OR attached_marker IS NOT NULL"""


def block_paragraphs(spark, sf_dir):
    """Paragraphs of blocks of eight lines, split where the font changes (ordered fold; no SQL form)."""
    line = view(spark, sf_dir, "line").withColumn("block", F.floor(F.col("line_index") / 8).cast("int"))
    return paragraphs.split_blocks(line.select("doc_id", "block", "line_index", "text", "font_size"), ["doc_id", "block"], ["line_index"]).select("doc_id", "line_index", "run")


def line_indents(spark, sf_dir):
    line = view(spark, sf_dir, "line").select("doc_id", "page_number", "line_index", F.col("l").alias("left"), F.col("r").alias("right"), F.when(F.col("line_index") % 8 == 0, "page_number").otherwise("paragraph").alias("block_type"))
    return paragraphs.indents(line, _KEYS).select("doc_id", "line_index", "left_indent", "right_indent")


LINE_INDENTS = duckdb("line") + """ SELECT doc_id, line_index, greatest(l - min(CASE WHEN line_index % 8 <> 0 THEN l END) OVER w, CAST(0 AS DOUBLE)) AS left_indent, greatest(max(CASE WHEN line_index % 8 <> 0 THEN r END) OVER w - r, CAST(0 AS DOUBLE)) AS right_indent FROM line WINDOW w AS (PARTITION BY doc_id, page_number)"""

QUERIES = {
    "line_marker_kinds": line_marker_kinds, "marker_values": marker_values, "list_sequences": list_sequences, "numbering_restarts": numbering_restarts, "indent_levels": indent_levels,
    "font_stats": font_stats, "block_classes": block_classes, "text_normalize": text_normalize, "font_names": font_names, "standalone_markers": standalone_markers, "block_paragraphs": block_paragraphs, "line_indents": line_indents, "color_and_units": color_and_units}
SQL = {
    "line_marker_kinds": LINE_MARKER_KINDS, "marker_values": MARKER_VALUES, "list_sequences": LIST_SEQUENCES, "numbering_restarts": NUMBERING_RESTARTS,
    "font_stats": FONT_STATS, "block_classes": BLOCK_CLASSES, "text_normalize": TEXT_NORMALIZE, "font_names": FONT_NAMES, "standalone_markers": STANDALONE_MARKERS, "line_indents": LINE_INDENTS, "color_and_units": COLOR_AND_UNITS}
