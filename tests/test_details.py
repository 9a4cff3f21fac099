"""Borders of cells, grid lines, identifiers, lookups, regions and outcomes on small cases."""

import json
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelattice.operators import edges, lookups, paths, regions, runs, tables
from pagelattice.plans.queries import QUERIES
from pagelattice.sources import bridge, info, pages

DATA = "/root/testdata/sf0.001"

BOX = "left double, top double, right double, bottom double"


def test_borders_lie_on_edges(spark):
    cells = spark.createDataFrame([(1, "a", 0.0, 0.0, 100.0, 50.0), (1, "b", 100.0, 0.0, 200.0, 50.0), (2, "a", 0.0, 0.0, 100.0, 50.0)], f"page int, cell string, {BOX}")
    line = lambda page, n, box, stroke=None, width=None, fill=None, kind="line", dashes=None: (page, n, kind, *box, stroke, width, fill, dashes)
    drawn = [
        line(1, 1, (0.0, 0.0, 200.0, 0.0), "#111111", 1.0), line(1, 2, (0.0, 0.5, 100.0, 0.5), "#222222", 2.0, dashes="dotted"), line(1, 3, (99.5, 0.0, 100.5, 50.0), None, None, "#333333"),
        line(1, 4, (0.0, 49.0, 30.0, 50.0), "#444444", 1.0), line(1, 5, (100.0, 0.0, 200.0, 50.0), "#555555", 0.5, None, "Rectangle", "[3 2] 0"), line(1, 6, (0.0, 10.0, 100.0, 40.0), None, None, "#666666"),
        line(2, 7, (None, 0.0, 1.0, 1.0), "#777777", 1.0), line(2, 8, (0.0, 0.0, 100.0, 9.0), "#888888", 9.0)]
    d = spark.createDataFrame(drawn, f"page int, ordinal int, drawing_type string, {BOX}, stroke_color string, stroke_width double, fill_color string, dashes string")
    found = edges.cell_borders(cells, d, ["page"], ["cell"])
    got = {(r.page, r.cell, r.edge): (r.width, r.style, r.color) for r in found.collect()}
    assert got == {
        (1, "a", "top"): (2.0, "dotted", "#222222"), (1, "a", "right"): (1.0, "single", "#333333"), (1, "b", "left"): (1.0, "single", "#333333"), (1, "b", "top"): (1.0, "single", "#111111"),
        (1, "b", "right"): (0.5, "dashed", "#555555"), (1, "b", "bottom"): (0.5, "dashed", "#555555")}
    whole = {(r.page, r.cell): {b.side: (b.style, b.width) for b in r.borders} for r in edges.with_borders(cells, found, ["page"], ["cell"], 0.25).collect()}
    assert whole[2, "a"] == dict.fromkeys(("top", "right", "bottom", "left"), ("single", 0.25)) and whole[1, "a"]["top"] == ("dotted", 2.0) and whole[1, "a"]["left"] == ("single", 0.25)


def test_borders_against_all_pairs(spark):
    rng = random.Random(7)
    box = lambda w, h: (x := rng.randrange(12) * 20.0, y := rng.randrange(12) * 20.0, x + w, y + h)
    cells = [(k % 3, k, *box(rng.choice([20.0, 60.0]), 20.0)) for k in range(90)]
    drawn = [(k % 3, k, rng.choice(["line", "rectangle"]), *rng.choice([box(200.0, 0.0), box(0.5, 150.0), box(20.0, 20.0), box(60.0, 20.0)]), "#000000", float(rng.randint(1, 4)), None, None) for k in range(60)]
    found = edges.cell_borders(spark.createDataFrame(cells, f"page int, cell int, {BOX}"), spark.createDataFrame(drawn, f"page int, ordinal int, drawing_type string, {BOX}, stroke_color string, stroke_width double, fill_color string, dashes string"), ["page"], ["cell"])
    want = {}
    for page, c, left, top, right, bottom in cells:
        for p, _, kind, x0, y0, x1, y1, _, w, _, _ in drawn:
            if p != page:
                continue
            near = lambda a, b: abs(a - b) <= 2.5
            same = kind == "rectangle" and near(x0, left) and near(y0, top) and near(x1, right) and near(y1, bottom)
            level = (y1 - y0 <= 3.5 or y1 - y0 <= w + 2.5) and max(min(x1, right) - max(x0, left), 0) / (right - left) >= 0.45
            upright = (x1 - x0 <= 3.5 or x1 - x0 <= w + 2.5) and max(min(y1, bottom) - max(y0, top), 0) / (bottom - top) >= 0.45
            on = {"top": level and near((y0 + y1) / 2, top), "bottom": level and near((y0 + y1) / 2, bottom), "left": upright and near((x0 + x1) / 2, left), "right": upright and near((x0 + x1) / 2, right)}
            for e in edges.EDGES:
                if same or on[e]:
                    want[c, e] = max(want.get((c, e), 0), min(w, 3.5))
    assert want and {(r.cell, r.edge): r.width for r in found.collect()} == want


def test_grid_lines_come_once(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 20.0, 0.5), (1, 40.0, 0.0, 80.0, 20.0, 0.5), (1, 0.0, 20.0, 80.0, 40.0, 0.5)], f"t int, {BOX}, thickness double")
    got = sorted(tuple(r)[1:] for r in edges.grid_lines(cells, ["t"], F.col("thickness")).collect())
    assert got == sorted([(0.0, -0.38, 80.0, 0.75), (0.0, 19.63, 80.0, 0.75), (0.0, 39.63, 80.0, 0.75), (-0.38, 0.0, 0.75, 40.0), (39.63, 0.0, 0.75, 20.0), (79.63, 0.0, 0.75, 40.0)])


def test_identifiers(spark):
    df = spark.createDataFrame([(1, None, "x", " 7 ", " Chart\n", None), (2, "12", "3", None, None, "  "), (3, None, None, None, None, "T9")], "k int, a string, b string, c string, kind string, name string")
    number = lookups.first_integer(F.col("a"), F.col("b"), F.col("c"))
    got = df.select("k", number.alias("n"), lookups.first_category(F.col("kind")).alias("c"), lookups.item_id(F.lit("table"), number, F.col("k")).alias("i"), lookups.table_id(F.lit(4), F.col("k"), F.col("name")).alias("t")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [(7, "chart", "table:7", "table:4:2"), (12, "", "table:12", "table:4:3"), (None, "", "table:4", "table:4:T9")]


def test_numbers_give_way(spark):
    rng = random.Random(2)
    rows = [(p, k, rng.choice([None, 1, 2, 3])) for p in range(4) for k in range(30)]
    got = {(r.page, r.k): r.item_number for r in lookups.numbered(spark.createDataFrame(rows, "page int, k int, own int"), ["page"], ["k"], "own").collect()}
    for p in range(4):
        used = set()
        for k, own in ((k, o) for q, k, o in rows if q == p):
            n = k + 1 if own is None else own
            while n in used:
                n += 1
            used.add(n)
            assert got[p, k] == n


def test_layout_by_source_then_number(spark):
    items = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 6, 2), (1, "c", None, 9), (1, "d", None, None)], "page int, item string, source_id int, region_number int")
    layout = spark.createDataFrame([(1, 10, 5, 2), (1, 11, None, 2), (1, 12, 7, 1)], "page int, layout_id int, source_id int, region_number int")
    assert {r.item: r.layout_id for r in lookups.with_layout(items, layout, ["page"]).collect()} == {"a": 10, "b": 11, "c": None, "d": None}


def test_marker_styles(spark):
    rows = [(1, 0, 0, 5.0, "•", "Symbol", 9.2), (1, 0, 1, 9.0, "text", "ABCDEF+HelveticaNeue-Bold", 18.43), (2, 0, 0, 5.0, "•", "Symbol", 9.2), (2, 1, 0, 5.0, " • ", "Symbol", 10.3), (3, 0, 0, 5.0, " ", "Symbol", 10.3), (3, 0, 1, 6.0, None, None, None)]
    df = spark.createDataFrame(rows, "k int, line_index int, span_index int, left double, text string, font string, font_size double").withColumn("marker", F.lit("•"))
    got = {r.k: (r.font, r.font_size) for r in lookups.marker_styles(df, ["k"]).collect()}
    assert got[1][1] == 18.5 and got[1][0] != "Symbol" and got[2] == ("Arial", 10.5) and got[3] == ("Arial", 11.0)


def test_outcome_of_merges(spark):
    cell = "t int, row_index int, column_index int, has_content boolean, synthetic boolean, want_rows int, want_cols int, geometry double, borderless double"
    rows = [(1, 0, 0, True, False, 1, 2, 0.9, 0.5), (1, 0, 1, False, True, 1, 1, 0.9, 0.5), (2, 0, 0, True, False, 1, 2, 0.9, 0.5), (2, 0, 1, True, False, 1, 1, 0.9, 0.5), (3, 0, 0, True, False, 1, 2, 0.1, 0.0), (3, 0, 1, False, True, 1, 1, 0.9, 0.5)]
    cells = spark.createDataFrame(rows, cell)
    attempts = lookups.merge_attempts(cells, ["t"])
    assert {r.t: r.outcome for r in attempts.collect()} == {1: "accepted", 2: "conflict", 3: "weak"}
    assert [r.t for r in tables.merges(cells, ["t"]).collect()] == [1]
    t = spark.createDataFrame([(k, 0.5, 0, "editable") for k in (1, 2, 3, 4)] + [(5, 0.5, 1, "editable")], "t int, confidence double, structure_errors int, disposition string")
    got = {r.t: (round(r.confidence, 6), r.disposition, r.evaluated) for r in lookups.merge_outcome(t, attempts, ["t"]).collect()}
    assert got == {1: (round(0.4 + 0.2 * 0.85, 6), "editable", 1), 2: (0.5, "visual_fallback", 1), 3: (0.5, "editable", 1), 4: (0.5, "editable", 0), 5: (0.5, "visual_fallback", 0)}


def test_renderable(spark):
    t = spark.createDataFrame([(k, 1, 2, "editable" if k != 1 else "skip") for k in range(1, 6)], "t int, row_count int, column_count int, disposition string")
    c = spark.createDataFrame([(k, 0, 0, 1, 1 if k == 2 else 2) for k in range(1, 6)], "t int, row_index int, column_index int, row_span int, column_span int")
    rows = spark.createDataFrame([(k,) for k in (1, 2, 4, 5)], "t int")
    columns = spark.createDataFrame([(k,) for k in (1, 2, 3, 5) for _ in (0, 1)], "t int")
    got = {r.t: (r.renderable, r.reason) for r in lookups.renderable(t, c, rows, columns, ["t"]).collect()}
    assert got == {1: (False, "not_editable"), 2: (False, "uncovered_positions"), 3: (False, "incomplete_rows"), 4: (False, "incomplete_columns"), 5: (True, None)}


def test_skipped_and_held_back_tables(spark):
    t = spark.createDataFrame([(k, 1, 1, 0.0, 0.0, 20.0, 20.0, 20.0, 20.0, 0.9, d) for k, d in enumerate(("editable", "skip", "visual_fallback", None))], f"t int, row_count int, column_count int, {BOX}, width double, height double, confidence double, disposition string")
    c = spark.createDataFrame([(k, 0, 0, 1, 1, False, True, None) for k in range(4)], "t int, row_index int, column_index int, row_span int, column_span int, synthetic boolean, has_content boolean, merge_confidence double")
    line = spark.createDataFrame([(k, 0, 0.0, 20.0) for k in range(4)], "t int, k int, start double, end double")
    borders = spark.createDataFrame([], "t int, style string, width double")
    got = {r.t: (r.decision, r.errors, r.native_confidence > 0) for r in tables.validated(t, c, line, line, borders, ["t"]).collect()}
    assert got == {0: ("native_safe", 0, True), 1: ("skip", 0, False), 2: ("visual_fallback", 0, True), 3: ("native_safe", 0, True)}


def test_regions_and_lines(spark):
    items = spark.createDataFrame([(1, 3, 7, [2, 1]), (1, 1, 7, [1]), (1, 2, 8, None), (1, 4, None, [9])], "page int, paragraph int, region int, source_block_numbers array<int>")
    found = regions.members(items, ["page"], "region", ["paragraph"])
    assert {r.region: (r.members, r.blocks) for r in found.collect()} == {7: ([1, 3], [1, 2]), 8: ([2], [])}
    entries = spark.createDataFrame([(1, 3, 5), (1, 1, 9)], "page int, paragraph int, reading_order int")
    assert {r.region: r.reading_order for r in regions.region_orders(found, entries, ["page"], "region").collect()} == {7: 5, 8: None}
    assert sorted((r.region, r.place, r.paragraph) for r in regions.nodes(found, items.drop("region"), ["page"], "region").collect()) == [(7, 0, 1), (7, 1, 3), (8, 0, 2)]
    spans = spark.createDataFrame([(1, "c", 9.0, 12.1), (1, "a", 5.0, 10.0), (1, "b", 1.0, 11.9), (1, "d", 0.0, 13.9), (1, "e", 0.0, 14.2)], "cell int, t string, left double, origin_y double")
    assert sorted((r.line, r.place, r.t) for r in regions.baseline_lines(spans, ["cell"]).collect()) == [(0, 0, "b"), (0, 1, "a"), (1, 0, "d"), (1, 1, "c"), (2, 0, "e")]


def test_runs_of_lines_against_a_fold(spark):
    """Random lines, with missing styles and sizes that drift, against one run after another; a long line in time of its length."""
    rng, tolerance = random.Random(4), 0.6
    words = ["a", "b,", "(", ")", " c", "d ", "e\u00a0", "", "  ", "f-"]
    rows = [(k, float(n * 10), n * 10 + rng.choice([9.0, 10.0, 9.99, 12.0]), rng.choice(words), rng.choice(["A", "A", "A", None]), rng.choice([9.0, 9.5, 10.0, 10.0, float("nan"), float("inf")]), rng.choice([True, True, True, None]), False, 0) for k in range(80) for n in range(rng.randint(1, 12))]
    long = [(999, n * 10.0, n * 10.0 + 8, "w", "A", 10.0, n // 4 % 2 == 1, False, 0) for n in range(4000)]
    df = spark.createDataFrame(rows + long, "k int, left double, right double, text string, font string, font_size double, bold boolean, italic boolean, color int")
    began = time.time()
    got = {r.k: [tuple(x) for x in r.runs] for r in runs.line_runs(df, ["k"], tolerance).collect()}
    assert time.time() - began < 60 and len(got[999]) == 1000 and got[999][0][0] == "w w w w "
    inline = lambda t: re.sub(" {2,}", " ", t.replace("\u00a0", " "))

    def append(out, text, style):
        font, size, bold, italic, color = style
        head = out[-1] if out else None
        near = head and abs(head[2] - size) <= tolerance and head[1] == font and None not in (head[3], bold) and head[3] == bold
        out[-1:] = [(head[0] + text, *head[1:])] if near else ([head] if head else []) + [(text, font, size, bold, italic, color)]

    for key in {r[0] for r in rows}:
        want, prior = [], None
        for _, left, right, text, *style in sorted(r for r in rows if r[0] == key):
            raw = inline(text)
            if not raw.strip():
                continue
            if prior:
                p, c, low = prior[1].rstrip(), raw.lstrip(), min((s for s in (prior[2][1], style[1]) if s == s), default=float("nan"))
                least = max(0.5, low * 0.04) if low == low else float("inf")
                blank = True if prior[1] != p or raw != c else False if c[0] in ".,;:!?%)]}" or p[-1] in "([{/\\–—" else left - prior[0] > 0 and left - prior[0] >= least
                if blank:
                    append(want, " ", prior[2])
            append(want, raw.strip(), style)
            prior = (right, raw, style)
        assert repr(got.get(key, [])) == repr(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name, weight", [("merged_segments", 1), ("document_profile", 1), ("page_policy", 1), ("page_profile", 1), ("grid_line_boxes", 4), ("page_coverage", 1), ("union_area", 1)])
def test_partitions_grow_with_the_input(spark, monkeypatch, name, weight):
    """6,000 rows in tasks of 500, of fewer where a row makes several: as many partitions to the end, whatever the session has."""
    monkeypatch.setattr(bridge, "ROWS", 500)
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() == 12 * weight


def test_documents_tell_of_themselves(spark, tmp_path):
    rows = ['{"doc_id": 1, "is_pdf": true, "permissions": -4, "metadata": {"title": " A ", "author": "", "creationDate": "D:20240131235959+01\'30\'", "modDate": "2024"}}', '{"doc_id": 2}', "{broken"]
    (tmp_path / "d.json").write_text("\n".join(rows))
    read = info.read_documents(spark, str(tmp_path / "d.json")).cache()
    assert read.where("corrupt_record is not null").count() == 1
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (9, 1)], "doc_id long, page_number int")
    got = {r.doc_id: r for r in info.document_info(read.where("doc_id is not null"), pages).withColumns({"c": F.unix_seconds("created"), "m": F.unix_seconds("modified")}).collect()}
    assert (got[1].page_count, got[1].title, got[1].author, got[1].permissions, got[1].needs_pass) == (2, "A", None, -4, False)
    assert (got[1].c, got[1].m) == (1706740199, 1704067200) and (got[2].page_count, got[2].is_pdf, got[2].c) == (0, False, None)
    odd = spark.createDataFrame([("D:20241",), ("D:20240231",), ("D:2024-01",), (None,), ("D:20240101000000-08",)], "d string")
    assert [r.s for r in odd.select(F.unix_seconds(info.pdf_date(F.col("d"))).alias("s")).collect()] == [1704067200, None, 1704070800, None, 1704096000]


def _winding(found, x, y):
    return sum((1 if y1 > y0 else -1) for x0, y0, x1, y1 in found if (y0 <= y) != (y1 <= y) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x)


def test_pieces_against_winding_numbers():
    """Random paths that cross themselves, in random clips, by points."""
    rng = random.Random(1)

    def shape(n):
        points = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
        return paths.edges([{"op": "l", "points": [*a, *b]} for a, b in zip(points, points[1:], strict=False)])

    for _ in range(25):
        every = [(shape(rng.randint(3, 9)), rng.random() < 0.5) for _ in range(rng.randint(1, 3))]
        found = paths.pieces(every)
        for _ in range(200):
            x, y = rng.uniform(0, 10), rng.uniform(0, 10)
            want = all(_winding(e, x, y) % 2 != 0 if odd else _winding(e, x, y) != 0 for e, odd in every)
            got = any(a <= y < b and l0 + (l1 - l0) * (y - a) / (b - a) <= x < r0 + (r1 - r0) * (y - a) / (b - a) for a, b, l0, r0, l1, r1 in found)
            assert want == got


def test_drawings_of_a_batch_at_once(monkeypatch):
    """Small drawings of a batch are worked on together, without a call for each, and have the pieces that they have alone."""
    rng, one = random.Random(2), paths.pieces
    point = lambda n: [float(rng.choice([rng.randint(0, 8), rng.uniform(0, 8)])) for _ in range(2 * n)]
    op = lambda: (lambda o: {"op": o, "points": point({"l": 2, "c": 4, "re": 2, "qu": 4, "x": 1}[o])[: rng.choice([8, 8, 8, 3])]})(rng.choice(["l", "l", "l", "c", "re", "qu", "x"]))
    path = lambda most: rng.choice([None, *([[op() for _ in range(rng.randint(0, most))]] * 9)])
    clip = lambda: {"box": rng.choice([None, [], point(2), [0.0, 0.0, 9.0, 9.0]]), "path": rng.choice([None, None, [], path(3)]), "even_odd": rng.choice([None, True, False])}
    row = lambda most, clips: {"path": path(most), "even_odd": rng.choice([None, True, False]), "clips": rng.choice([None, [clip() for _ in range(clips)]])}
    lines = pa.list_(pa.struct([("op", pa.string()), ("points", pa.list_(pa.float64()))]))
    kind = pa.struct([("path", lines), ("even_odd", pa.bool_()), ("clips", pa.list_(pa.struct([("box", pa.list_(pa.float64())), ("path", lines), ("even_odd", pa.bool_())])))])
    calls = []
    monkeypatch.setattr(paths, "pieces", lambda every: calls.append(1) or one(every))
    for rows, few in (([row(4, 2) for _ in range(300)], True), ([row(30, rng.randint(0, 12)) for _ in range(60)], False), ([], True)):
        calls.clear()
        counts, found = paths._batch(*pa.array(rows, kind).flatten())
        many = [sum(len(paths.edges(p)) for p in (r["path"], *(c["path"] or [{"op": "re", "points": c["box"]}] for c in r["clips"] or []))) for r in rows]
        assert len(calls) == 0 if few and max(many, default=0) <= paths.SMALL else len(calls) <= len(rows)
        ends = np.append(0, np.cumsum(counts))
        for k, r in enumerate(rows):
            want = one([(paths.edges(r["path"]), bool(r["even_odd"])), *((paths.edges(c["path"]), bool(c["even_odd"])) if c["path"] else (paths.edges([{"op": "re", "points": c["box"]}]), False) for c in r["clips"] or [] if c["path"] or c["box"])])
            assert found[ends[k] : ends[k + 1]].shape == want.shape and np.allclose(found[ends[k] : ends[k + 1]], want, atol=1e-9)


def test_painted_drawings(spark):
    c = 0.5522847498
    circle = [("c", [1.0, 0.0, 1.0, c, c, 1.0, 0.0, 1.0]), ("c", [0.0, 1.0, -c, 1.0, -1.0, c, -1.0, 0.0]), ("c", [-1.0, 0.0, -1.0, -c, -c, -1.0, 0.0, -1.0]), ("c", [0.0, -1.0, c, -1.0, 1.0, -c, 1.0, 0.0])]
    quad, square = [("qu", [0.0, 0.0, 4.0, 0.0, 0.0, 2.0, 4.0, 2.0])], [("re", [0.0, 0.0, 2.0, 2.0])]
    half = [([-9.0, -9.0, 9.0, 0.0], None, None)]
    rows = [
        (1, circle, None, None), (2, circle, False, half), (3, quad, False, [(None, square, False)]), (4, square + square, True, []), (5, square + square, False, []), (6, None, None, None), (7, [("l", [0.0, 0.0, 5.0, 5.0]), ("x", None), ("l", [1.0]), ("re", [0.0, None, 1.0, 1.0])], None, None),
        (8, square, None, [(None, None, None)]), (9, square, None, [([5.0, 5.0, 9.0, 9.0], None, None)]), (10, [("re", [2.0, 2.0, 0.0, 0.0])], None, None)]
    df = spark.createDataFrame(rows, f"k int, path {paths.PATH}, even_odd boolean, clips array<struct<box:array<double>,path:{paths.PATH},even_odd:boolean>>").withColumn("area", F.lit("x"))
    got = {r.k: r for r in paths.painted(df, ["k"]).collect()}
    assert abs(got[1].area - 3.14159) < 0.15 and abs(got[2].area - got[1].area / 2) < 1e-6
    assert {k: round(r.area, 9) for k, r in got.items() if k > 2} == {3: 4.0, 4: 0.0, 5: 4.0, 6: 0.0, 7: 0.0, 8: 4.0, 9: 0.0, 10: 4.0}
    assert tuple(got[5].pieces[0]) == (0.0, 2.0, 0.0, 2.0, 0.0, 2.0) and got[6].pieces == []
    assert paths.painted(df.limit(0), ["k"]).collect() == []


def test_paths_and_clips_of_decoded_pages(spark, tmp_path):
    square = lambda *box: [{"op": "re", "points": list(box)}]
    shape = lambda kind, level, path, **more: {"type": kind, "level": level, "rect": [0, 0, 9, 9], "scissor": [0, 0, 4, 9], "items": ["re"], "path": path, **more}
    drawn = [shape("clip", "0", None), shape("f", "1", square(0, 0, 8, 2)), shape("clip", "1", square(0, 0, 9, 1)), shape("f", "2", square(0, 0, 8, 2)), shape("f", "0", square(0, 0, 8, 2))]
    (tmp_path / "p.json").write_text(json.dumps({"doc_id": 1, "page_number": 1, "blocks": [], "drawings": drawn}))
    vectors = pages.vectors(pages.read_pages(spark, str(tmp_path / "p.json")))
    assert [r.area for r in paths.painted(vectors, ["doc_id", "sequence_number"]).orderBy("sequence_number").collect()] == [8.0, 4.0, 16.0]
