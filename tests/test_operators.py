"""Order-dependent operators and functions without an SQL form, on small cases."""

import random
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import functions as F

from pagelattice.functions import text as X
from pagelattice.functions.geometry import Box
from pagelattice.operators import alignment, layout, lists, paragraphs, tables, unicode, vectors
from pagelattice.operators.coverage import coverage, union_area
from pagelattice.sources import docx, pages, reports

BOX = "left double, top double, right double, bottom double"


def area_of(spark, boxes, clip=None):
    df = spark.createDataFrame([(1, *b) for b in boxes], f"page int, {BOX}")
    clip = Box(*(F.lit(float(x)) for x in clip)) if clip else None
    return union_area(df, ["page"], Box.of(), clip).collect()[0].union_area


def test_union_area(spark):
    assert area_of(spark, [(0.0, 0.0, 10.0, 10.0), (20.0, 0.0, 30.0, 10.0)]) == 200
    assert area_of(spark, [(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0)]) == 175
    assert area_of(spark, [(0.0, 0.0, 10.0, 10.0)] * 2) == 100
    assert area_of(spark, [(-10.0, -10.0, 20.0, 20.0)], (0, 0, 10, 10)) == 100
    assert area_of(spark, [(0.0, 0.0, 10.0, 10.0), (None, None, None, None), (5.0, 5.0, 5.0, 9.0)]) == 100


def test_union_area_random(spark):
    rng = random.Random(3)
    for _ in range(3):
        boxes = [(float(x), float(y), float(x + rng.randint(0, 9)), float(y + rng.randint(0, 9))) for x, y in [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(12)]]
        cells = {(i, j) for l, t, r, b in boxes for i in range(int(l), int(r)) for j in range(int(t), int(b))}  # noqa: E741
        assert area_of(spark, boxes) == len(cells)


def test_coverage_is_a_share(spark):
    df = spark.createDataFrame([(1, -100.0, -100.0, 200.0, 200.0)], f"page int, {BOX}")
    assert coverage(df, ["page"], Box.of(), Box(*(F.lit(x) for x in (0.0, 0.0, 100.0, 100.0))), 1e4).collect()[0].coverage == 1.0


def test_markers(spark):
    cases = {"1. One": ("1.", "decimal", 1), "• dot": ("•", "bullet", None), "(iv) four": ("(iv)", "lower_roman", 4), "i. one": ("i.", "lower_roman", 9), "1.2. deep": ("1.2.", "multilevel_decimal", None), "B) big": ("B)", "upper_alpha", 2), "XIV. x": ("XIV.", "upper_roman", 14), "word": (None, None, None), "٣. arabic": ("٣.", "decimal", None)}
    df = spark.createDataFrame([(t,) for t in cases], "text string").withColumn("m", X.text_marker("text"))
    got = {r.text: (r.m, r.k, r.n) for r in df.select("text", "m", X.marker_kind(F.col("m")).alias("k"), X.marker_number(F.col("m")).alias("n")).collect()}
    for t, (marker, kind, number) in cases.items():
        assert got[t][:2] == (marker, kind), t
        if "٣" not in t:
            assert got[t][2] == number, t


def test_paragraphs_merge_and_break(spark):
    rows = [
        (1, 0, 0, "1. Numbered item that", 10.0, 50.0, 100.0, 155.0, 112.0), (1, 0, 1, "goes on here.", 10.0, 62.0, 114.0, 200.0, 126.0),
        (1, 1, 2, "left", 10.0, 50.0, 200.0, 80.0, 212.0), (1, 1, 3, "right", 10.0, 90.0, 200.5, 120.0, 212.5), (1, 2, 4, "Far below.", 10.0, 50.0, 400.0, 120.0, 412.0)]
    df = spark.createDataFrame(rows, "page int, block int, line_index int, text string, font_size double, left double, top double, right double, bottom double")
    got = [(r.region_number, r.text, r.marker) for r in paragraphs.paragraphs(df, ["page"]).orderBy("region_number").collect()]
    assert got == [(1, "1. Numbered item that\ngoes on here.", "1."), (2, "left right", None), (3, "Far below.", None)]


def test_bullets_are_taken_once(spark):
    p = spark.createDataFrame([(1, 1, 100.0, 50.0, 62.0), (1, 2, 100.0, 54.0, 66.0)], "page int, region int, left double, first_top double, first_bottom double")
    b = spark.createDataFrame([(1, 9, 84.0, 52.0, 90.0, 58.0)], "page int, bullet_id int, left double, top double, right double, bottom double")
    assert [(r.region, r.bullet_id) for r in paragraphs.attach_bullets(p, b, ["page"], "region").collect()] == [(1, 9)]


def test_columns(spark):
    two = [(1, k, "more than twenty characters of text", x, 100.0 + 60 * j, x + 220, 140.0 + 60 * j) for x in (50.0, 340.0) for j in range(3) for k in [int(x) + j]]
    df = spark.createDataFrame([*two, (1, 999, "a title that is as wide as the page", 50.0, 60.0, 560.0, 80.0)], "page int, item int, text string, left double, top double, right double, bottom double")
    got = {r.item: r.column_index for r in layout.columns(df, ["page"], "item").collect()}
    assert got == {50: 0, 51: 0, 52: 0, 340: 1, 341: 1, 342: 1, 999: None}
    one = df.where("item < 300")
    assert {(r.column_index, r.confidence) for r in layout.columns(one, ["page"], "item").collect()} == {(0, 0.78)}


def test_reading_order_of_spans_and_columns(spark):
    rows = [(1, 1, 50.0, 60.0, 560.0, 80.0, None), (1, 2, 50.0, 100.0, 270.0, 140.0, 0), (1, 3, 50.0, 150.0, 270.0, 190.0, 0), (1, 4, 340.0, 100.0, 560.0, 140.0, 1), (1, 5, 340.0, 150.0, 560.0, 190.0, 1)]
    df = spark.createDataFrame(rows, f"page int, item int, {BOX}, column_index int").withColumns({"band": F.lit(None).cast("string"), "column_count": F.lit(2), "in_body": F.lit(True), "rtl": F.lit(False)})
    got = [(r.item, r.role) for r in layout.reading_order(df, ["page"], "item").orderBy("reading_order").collect()]
    assert got == [(1, "body_spanning"), (2, "column"), (3, "column"), (4, "column"), (5, "column")]


def test_list_levels_and_restarts(spark):
    rows = [(1, k, t, left, top, top + 18) for k, (t, left, top) in enumerate([("1. a", 80.0, 100.0), ("2. b", 115.0, 125.0), ("3. c", 80.0, 150.0), ("1. d", 80.0, 175.0), ("1. far", 80.0, 400.0)])]
    df = lists.items(spark.createDataFrame(rows, "page int, line int, text string, left double, top double, bottom double"))
    runs = lists.restarts(lists.sequences(df, ["page"], ["line"]), ["page"], ["line"])
    got = [(r.run, r.part, r.level) for r in lists.levels(runs, ["page"], 500.0).orderBy("line").collect()]
    assert got == [(1, 0, 0), (1, 0, 1), (1, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_vector_groups_do_not_merge(spark):
    rows = [(1, 1, "unknown", 0.0, 0.0, 10.0, 10.0), (1, 2, "unknown", 15.0, 0.0, 25.0, 10.0), (1, 3, "chart", 16.0, 0.0, 26.0, 10.0), (1, 4, "unknown", 300.0, 0.0, 310.0, 10.0)]
    df = spark.createDataFrame(rows, f"page int, id int, category string, {BOX}")
    assert [r.group_number for r in vectors.groups(df, ["page"], "id", 612.0, 792.0).orderBy("id").collect()] == [1, 1, 2, 3]


def test_merges_take_free_cells_once(spark):
    rows = [(1, 0, 0, True, False, 1, 2), (1, 0, 1, False, True, 1, 1), (1, 1, 0, True, False, 1, 2), (1, 1, 1, True, False, 1, 1)]
    df = spark.createDataFrame(rows, "t int, row_index int, column_index int, has_content boolean, synthetic boolean, want_rows int, want_cols int").withColumns({"geometry": F.lit(0.95), "borderless": F.lit(1.0)})
    assert [(r.row_index, r.column_span) for r in tables.merges(df, ["t"]).collect()] == [(0, 2)]


def test_grid_boundary_is_interpolated(spark):
    t = spark.createDataFrame([("t", 3, 0.0, 90.0)], "t string, n int, top double, bottom double")
    c = spark.createDataFrame([("t", 0, 2, 0.0, 60.0), ("t", 2, 1, 60.0, 90.0)], "t string, i int, s int, a double, b double")
    got = tables.boundaries(c, t, ["t"], "i", "s", "a", "b", "n", ("top", "bottom")).orderBy("k").collect()
    assert [(r.position, r.confidence) for r in got] == [(0.0, 0.95), (30.0, 0.6), (60.0, 0.95), (90.0, 0.95)]


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁne",), ("Straße",), ("שלום",), (None,)], "t string")
    assert [r.x for r in df.select(unicode.nfkc(F.col("t")).alias("x")).collect()] == ["fine", "Straße", "שלום", None]
    assert [r.x for r in df.select(unicode.casefold(F.col("t")).alias("x")).collect()][1] == "strasse"
    counts = df.select(unicode.direction_counts(F.col("t")).alias("c")).select("c.*").collect()
    assert [(r.rtl, r.ltr) for r in counts] == [(0, 3), (0, 6), (4, 0), (0, 0)]


def _page():
    span = {"text": "Hi", "font": "Arial", "size": 10.0, "color": 255, "flags": 16, "bbox": [1.0, 2.0, 3.0, 4.0], "origin": [1.0, 4.0]}
    drawings = [{"type": "clip", "level": "0", "scissor": [0.0, 0.0, 9.0, 9.0]}, {"type": "f", "level": "1", "rect": [1.0, 1.0, 2.0, 2.0], "fill": [1.0, 0.0, 0.0], "items": ["re"]}, {"type": "s", "level": "0", "rect": [1.0, 1.0, 2.0, 2.0], "width": "x", "items": ["l", "c"]}, {"type": "f", "level": "1"}]
    return {"doc_id": 1, "page_number": 1, "blocks": [{"type": 0, "lines": [{"spans": [span]}]}, {"type": 1, "bbox": [0.0, 0.0, 5.0, 5.0]}], "drawings": drawings}


def test_sources_and_stream(spark, tmp_path):
    import json

    from pagelattice.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(_page()) + "\n")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "b.json").write_text(json.dumps(_page()) + "\n{broken\n")
    odd = pages.read_pages(spark, str(tmp_path / "odd")).cache()
    assert sorted(str(r.corrupt_record) for r in odd.collect()) == ["None", "{broken"] and pages.spans(odd).count() == 1
    p = pages.read_pages(spark, str(tmp_path / "in"))
    assert [(r.text, r.rgb.blue, r.left) for r in pages.spans(p).collect()] == [("Hi", 255, 1.0)]
    assert [(r.ext, r.xres) for r in pages.images(p).collect()] == [("png", 72)]
    assert [(r.sequence_number, r.drawing_type, r.fill_color, len(r.clips)) for r in pages.vectors(p).orderBy("sequence_number").collect()] == [(2, "rectangle", "#FF0000", 1), (3, "compound", None, 0)]
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/spans")).count() == 1


def test_docx_and_json(spark, tmp_path):
    cell = {"row_index": 0, "column_index": 0, "row_span": 2, "column_span": 1, "text": "in a cell", "fill": None}
    df = spark.createDataFrame([(7, 1, 1, "First <b>", "center", None), (7, 2, 1, "Second", None, None), (7, 1, 2, None, None, [cell])], "doc_id int, page_number int, render_order int, text string, alignment string, cells array<struct<row_index:int,column_index:int,row_span:int,column_span:int,text:string,fill:string>>")
    (row,) = docx.documents(df).collect()
    body = zipfile.ZipFile(BytesIO(row.docx)).read("word/document.xml").decode()
    assert body.index("First &lt;b&gt;") < body.index("in a cell") < body.index("Second") and 'w:val="center"' in body and "vMerge" in body
    fixed = df.where("cells is null").withColumns({"left": F.lit(1.0), "top": F.lit(2.0), "right": F.lit(3.0), "bottom": F.lit(4.0)})
    assert "margin-left:1.00pt" in zipfile.ZipFile(BytesIO(docx.documents(fixed, fixed=True).collect()[0].docx)).read("word/document.xml").decode()
    reports.write_report(df.select("doc_id").limit(1), df.select("page_number"), str(tmp_path / "x/r.json"))
    assert '"issues"' in (tmp_path / "x/r.json").read_text()


def test_drawing_groups_are_visited_from_the_top(spark):
    boxes = [(9, 10.0, 10.0, 20.0, 20.0), (1, 200.0, 300.0, 220.0, 310.0), (5, 25.0, 12.0, 40.0, 22.0), (2, 45.0, 14.0, 60.0, 25.0), (3, 11.0, 10.0, 12.0, 11.0)]
    df = spark.createDataFrame([(1, i, "icon", *b) for i, *b in boxes], "page int, id int, category string, left double, top double, right double, bottom double")
    got = {r.id: (r.group_number, r.group_left, r.group_bottom) for r in vectors.groups(df, ["page"], "id", 600.0, 800.0).collect()}
    assert {i: g[0] for i, g in got.items()} == {9: 1, 3: 1, 5: 1, 2: 1, 1: 2} and got[9][1:] == (10.0, 25.0) and got[1][1:] == (200.0, 310.0)


def test_table_validation_faults(spark):
    t = spark.createDataFrame([(k, 1, 2, 0.0, 0.0, 200.0, 20.0, 200.0, 20.0, 0.9, 90.0 if k == 6 else None, k == 7) for k in range(8)], "table_id int, row_count int, column_count int, left double, top double, right double, bottom double, width double, height double, confidence double, rotation double, has_vertical_text boolean")
    cells = spark.createDataFrame([(k, 0, c, 1, 1, False, True, None) for k in range(8) for c in (0, 1)], "table_id int, row_index int, column_index int, row_span int, column_span int, synthetic boolean, has_content boolean, merge_confidence double")
    rows = spark.createDataFrame([(k, 0, 0.0, 20.0) for k in range(8) if k != 1], "table_id int, k int, start double, end double")
    edge = {2: 120.0, 3: 90.0, 4: 198.0}
    columns = spark.createDataFrame([r for k in range(8) for r in ((k, 0, 0.0, edge.get(k, 100.0)), (k, 1, 198.0 if k == 4 else 100.0, 200.0))], "table_id int, k int, start double, end double")
    borders = spark.createDataFrame([(k, "wavy" if k == 5 else "single", 0.5) for k in range(8) for _ in range(8)], "table_id int, style string, width double")
    got = {r.table_id: r for r in tables.validated(t, cells, rows, columns, borders, ["table_id"]).collect()}
    assert {k: r.decision for k, r in got.items()} == {0: "native_safe", 3: "native_with_warnings"} | dict.fromkeys((1, 2, 4, 5, 6, 7), "visual_fallback")
    assert (got[0].geometry_score, got[1].geometry_score, got[5].style_score, got[5].errors) == (1.0, 0.5, 0.0, 8)
    assert abs(got[2].geometry_score - 0.94) < 1e-9 and got[4].errors == 1 and got[3].warnings == 1


def test_results_against_paragraphs(spark):
    p = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, None)], "page int, n int")
    r = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (1, 9), (2, 9), (2, 9)], "page int, n int")
    got = sorted((x.page, x.n or 0, x.code, x.severity) for x in alignment.result_issues(p, r, ["page", "n"]).collect())
    assert got == [(1, 0, "missing_result", "error"), (1, 1, "missing_result", "error"), (1, 3, "duplicate_result", "error"), (1, 9, "extra_result", "warning"), (2, 9, "duplicate_result", "error"), (2, 9, "extra_result", "warning")]
    assert alignment.result_issues(p.limit(0), r.limit(0), ["page", "n"]).count() == 0


def test_docx_borders(spark):
    borders = [("right", "dotted", 0.1, None), ("top", "double", 1.5, "#ff00aa"), ("left", "none", 1.0, None), ("top", "single", 9.0, None), ("bottom", "wavy", None, None)]
    side = "array<struct<side:string,style:string,width:double,color:string>>"
    cells = [(0, c, 1, 1, "x", None, borders if c else None) for c in (0, 1)]
    df = spark.createDataFrame([(1, 1, 1, cells)], f"doc_id int, page_number int, render_order int, cells array<struct<row_index:int,column_index:int,row_span:int,column_span:int,text:string,fill:string,borders:{side}>>")
    root = ElementTree.fromstring(zipfile.ZipFile(BytesIO(docx.documents(df).collect()[0].docx)).read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    (found,) = root.iter(f"{w}tcBorders")
    got = [(e.tag.removeprefix(w), e.get(f"{w}val"), e.get(f"{w}sz"), e.get(f"{w}color")) for e in found]
    assert got == [("top", "double", "12", "FF00AA"), ("left", "nil", "0", "000000"), ("bottom", "single", "2", "000000"), ("right", "dotted", "2", "000000")]
