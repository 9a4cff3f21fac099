"""DuckDB SQL of the queries whose operators fold rows in order: recursion along the row numbers of a group."""

from __future__ import annotations

from pagelattice.functions.text import NO_BLANK_AFTER, NO_BLANK_BEFORE
from pagelattice.plans import styles
from pagelattice.plans.lines import _RUNS
from pagelattice.plans.tables import _WITH
from pagelattice.sources.bridge import duckdb


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_NEAR = lambda a, b: f"abs({a} - {b}) <= greatest(CAST(1 AS DOUBLE), greatest(abs({a}), abs({b})) * CAST(0.002 AS DOUBLE))"
PAGE_SIZE_GROUPS = f"""WITH RECURSIVE p AS (SELECT o_custkey AS doc, o_orderkey AS page, CAST(600 + o_orderkey % 7 AS DOUBLE) AS w, CAST(790 + o_custkey % 3 AS DOUBLE) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT doc, page, n, [{{'w': w, 'h': h}}] AS firsts, 1 AS g FROM p WHERE n = 1
  UNION ALL SELECT doc, page, n, CASE WHEN hit IS NULL THEN list_append(firsts, {{'w': w, 'h': h}}) ELSE firsts END, CAST(coalesce(hit, len(firsts) + 1) AS INTEGER) FROM (
    SELECT p.*, firsts, list_min(list_filter(range(1, len(firsts) + 1), lambda i: {_NEAR('firsts[i].w', 'p.w')} AND {_NEAR('firsts[i].h', 'p.h')})) AS hit FROM f JOIN p ON p.doc = f.doc AND p.n = f.n + 1))
SELECT doc, page, CAST(g AS INTEGER) AS size_group FROM f"""

BLOCK_PARAGRAPHS = _recursive(duckdb("line")) + """, x AS (SELECT doc_id, CAST(floor(line_index / 8) AS INTEGER) AS block, line_index, font_size AS s, trim(text) = '' AS e, row_number() OVER (PARTITION BY doc_id, floor(line_index / 8) ORDER BY line_index) AS n FROM line),
f AS (SELECT doc_id, block, line_index, n, CASE WHEN e THEN 0 ELSE 1 END AS last, CASE WHEN e THEN NULL ELSE s END AS font, CASE WHEN e THEN NULL ELSE 1 END AS run FROM x WHERE n = 1
  UNION ALL SELECT x.doc_id, x.block, x.line_index, x.n, CASE WHEN e THEN last WHEN font IS NULL OR abs(s - font) > CAST(0.5 AS DOUBLE) THEN last + 1 ELSE last END, CASE WHEN e THEN NULL WHEN font IS NULL OR abs(s - font) > CAST(0.5 AS DOUBLE) THEN s ELSE font END,
    CASE WHEN e THEN NULL WHEN font IS NULL OR abs(s - font) > CAST(0.5 AS DOUBLE) THEN last + 1 ELSE last END FROM f JOIN x ON x.doc_id = f.doc_id AND x.block = f.block AND x.n = f.n + 1)
SELECT doc_id, line_index, CAST(run AS INTEGER) AS run FROM f"""

# A merge takes positions, as row * 100 + column, that are still free.
ACCEPTED_MERGES = _recursive(_WITH) + """, g AS (SELECT table_id, row_index, column_index, bool_or(has_content) AS has, bool_and(synthetic) AS made, max(row_span) AS h, max(column_span) AS w FROM c GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_index, column_index) AS n, NOT made AND has AND (h > 1 OR w > 1) AS wants, list_filter(flatten(list_transform(range(0, h), lambda i: list_transform(range(0, w), lambda j: (row_index + i) * 100 + column_index + j))), lambda p: p <> row_index * 100 + column_index) AS fresh FROM g),
f AS (SELECT table_id, CAST(0 AS BIGINT) AS n, list(row_index * 100 + column_index) FILTER (made AND NOT has) AS free, false AS took FROM g GROUP BY table_id
  UNION ALL SELECT table_id, n, CASE WHEN ok THEN list_filter(free, lambda p: NOT list_contains(fresh, p)) ELSE free END, ok FROM (SELECT x.table_id, x.n, free, fresh, wants AND list_has_all(coalesce(free, []), fresh) AS ok FROM f JOIN x ON x.table_id = f.table_id AND x.n = f.n + 1))
SELECT x.table_id, row_index, column_index, CAST(h AS INTEGER) AS row_span, CAST(w AS INTEGER) AS column_span, CAST(0.75 AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.15 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS confidence FROM f JOIN x ON x.table_id = f.table_id AND x.n = f.n WHERE took"""

_WIDE = "CAST(468 AS DOUBLE) * CAST(0.018 AS DOUBLE)"
INDENT_LEVELS = _recursive(_RUNS) + f""", iv AS (SELECT doc_id, page_number, run, part, l, row_number() OVER (PARTITION BY doc_id, page_number, run, part ORDER BY l) AS n FROM s WHERE run IS NOT NULL),
f AS (SELECT doc_id, page_number, run, part, n, [[l]] AS groups FROM iv v WHERE n = 1
  UNION ALL SELECT v.doc_id, v.page_number, v.run, v.part, v.n, CASE WHEN abs(l - list_median(groups[-1])) <= greatest(CAST(8 AS DOUBLE), {_WIDE}) THEN list_append(groups[:-2], list_append(groups[-1], l)) ELSE list_append(groups, [l]) END
  FROM f JOIN iv v ON v.doc_id = f.doc_id AND v.page_number = f.page_number AND v.run = f.run AND v.part = f.part AND v.n = f.n + 1),
c AS (SELECT doc_id, page_number, run, part, list_transform(arg_max(groups, n), lambda a: list_median(a)) AS centres FROM f GROUP BY ALL),
d AS (SELECT s.*, list_transform(centres, lambda m: abs(m - l)) AS far FROM s JOIN c ON c.doc_id = s.doc_id AND c.page_number = s.page_number AND c.run = s.run AND c.part = s.part)
SELECT doc_id, line_index, CAST(least(greatest(list_position(far, list_min(far)) - 1, explicit_level, 0), 8) AS INTEGER) AS level FROM d"""

SHARED_DEFINITIONS = f"""WITH def AS ({styles.NUMBERING_DEFINITIONS}), each AS (SELECT doc_id, page_number, run, list({{'l': level, 'k': kind, 'f': format, 't': text, 'a': left_twips, 'h': hanging_twips}} ORDER BY level) AS d FROM def GROUP BY ALL),
least_ AS (SELECT d, min({{'a': doc_id, 'b': page_number, 'c': run}}) AS m, count(*) AS runs FROM each GROUP BY d) SELECT m.a AS doc_id, m.b AS page_number, m.c AS run, runs FROM least_"""

_CHARS = lambda s: ", ".join(f"'{c}'" for c in s)
STYLED_RUNS = duckdb("line") + f""", w AS (SELECT doc_id, line_index, font_size, unnest(range(len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS raw FROM line),
t AS (SELECT doc_id, line_index, font_size, k, regexp_replace(regexp_replace(translate(raw, chr(160) || chr(8239) || chr(8199), '   '), '[\\t\\r\\n\\f\\v]+', ' ', 'g'), ' {{2,}}', ' ', 'g') AS raw, k * 30 AS l, k * 30 + 28 + k % 3 AS r, k // 4 % 2 AS bold FROM w), u AS (SELECT *, trim(raw) AS x FROM t WHERE trim(raw) <> ''),
p AS (SELECT *, lag(raw) OVER v AS pr, lag(x) OVER v AS px, l - lag(r) OVER v AS gap, lag(bold) OVER v AS pb FROM u WINDOW v AS (PARTITION BY doc_id, line_index ORDER BY k)),
b AS (SELECT *, CASE WHEN pr IS NULL THEN false WHEN pr LIKE '% ' OR raw LIKE ' %' THEN true WHEN left(x, 1) IN ({_CHARS(NO_BLANK_BEFORE)}) OR right(px, 1) IN ({_CHARS(NO_BLANK_AFTER)}) THEN false ELSE gap > 0 AND gap >= greatest(CAST(0.5 AS DOUBLE), greatest(font_size, CAST(1 AS DOUBLE)) * CAST(0.04 AS DOUBLE)) END AS blank, CASE WHEN pb <> bold THEN 1 ELSE 0 END AS turn FROM p)
SELECT doc_id, line_index, CAST(1 + sum(turn) AS INTEGER) AS n_runs, string_agg(CASE WHEN blank THEN ' ' ELSE '' END || CASE WHEN turn = 1 THEN '|' ELSE '' END || x, '' ORDER BY k) AS text FROM b GROUP BY doc_id, line_index"""

SQL = {
    "page_size_groups": PAGE_SIZE_GROUPS, "block_paragraphs": BLOCK_PARAGRAPHS, "accepted_merges": ACCEPTED_MERGES, "indent_levels": INDENT_LEVELS, "shared_definitions": SHARED_DEFINITIONS, "styled_runs": STYLED_RUNS}
