"""Ruled tables against brute force, grid repair, and written packages read back from their XML."""

import io
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import media, numbering, reconstruction, ruling, stories
from pagelattice.sources import pages, word

BOX = "left double, top double, right double, bottom double"
W = f"{{{word._NAMES['w']}}}"
R = f"{{{word._NAMES['r']}}}"


def brute_lines(segments):
    """(at, start, end) of one direction, snapped and joined."""
    at, by, out = {}, {}, []
    values = [s[0] for s in segments]
    groups, last = [], None
    for v in sorted(values):
        if last is None or v - last > 3:
            groups.append([])
        groups[-1].append(v)
        last = v
    for g in groups:
        at |= dict.fromkeys(g, sum(g) / len(g))
    for p, a, z in segments:
        by.setdefault(at[p], []).append((a, z))
    for p, parts in by.items():
        cur = None
        for a, z in sorted(parts):
            if cur and a <= cur[1] + 3:
                cur[1] = max(cur[1], z)
            else:
                cur = [a, z]
                out.append((p, cur))
    return [(p, a, z) for p, (a, z) in out if z - a >= 3]


def brute_cells(flat, upright):
    hs, vs = brute_lines(flat), brute_lines(upright)
    points = {(i, j): (vs[j][0], hs[i][0]) for i, h in enumerate(hs) for j, v in enumerate(vs) if h[1] - 3 <= v[0] <= h[2] + 3 and v[1] - 3 <= h[0] <= v[2] + 3}
    cells = {}
    for (h, v), (x, y) in points.items():
        found = [(points[b][1], points[r][0]) for r in points if r[0] == h and points[r][0] > x for b in points if b[1] == v and points[b][1] > y and (b[0], r[1]) in points]
        if found:
            cells[x, y] = min([*found, *([cells[x, y]] if (x, y) in cells else [])])
    return {(x, y, r, b) for (x, y), (b, r) in cells.items()}, set(points.values())


def near(corner):
    """Means of positions may differ in their last digits."""
    return tuple(round(x, 6) for x in corner)


def drawings(spark, rows):
    return spark.createDataFrame(rows, f"page int, {BOX}, stroke_color string, stroke_width double, fill_color string")


def test_cells_of_random_rulings(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for page in range(25):
        flat, upright = [], []
        for _ in range(rng.randint(0, 24)):
            p, a = rng.randint(0, 6) * 20.0 + rng.choice([0, 0, 1, 2]), rng.randint(0, 5) * 20.0 + rng.choice([0, 0, 2, 4])
            flat.append((p, a, a + rng.randint(1, 6) * 20.0))
        for _ in range(rng.randint(0, 24)):
            p, a = rng.randint(0, 6) * 20.0 + rng.choice([0, 0, 1, 2]), rng.randint(0, 5) * 20.0 + rng.choice([0, 0, 2, 4])
            upright.append((p, a, a + rng.randint(1, 6) * 20.0))
        rows += [(page, a, p, z, p, "#000000", 0.5, None) for p, a, z in flat] + [(page, p - 0.5, a, p + 0.5, z, None, None, "#123456") for p, a, z in upright]
        want[page] = brute_cells(flat, upright)
    rng.shuffle(rows)
    lines = ruling.rulings(ruling.segments(drawings(spark, rows), ["page"]), ["page"])
    points = ruling.corners(lines, ["page"])
    got = {}
    for r in points.collect():
        got.setdefault(r.page, set()).add(near((r.x, r.y)))
    assert got == {p: set(map(near, c)) for p, (_, c) in want.items() if c}
    got = {}
    for r in ruling.cells(points, ["page"]).collect():
        got.setdefault(r.page, set()).add(near((r.left, r.top, r.right, r.bottom)))
    assert got == {p: set(map(near, c)) for p, (c, _) in want.items() if c} and sum(map(len, got.values())) > 50


def test_a_line_that_ends_early_does_not_hide_a_cell(spark):
    """The next line down stops halfway and the one after it closes the cell."""
    rows = [(1, 0.0, 0.0, 100.0, 0.0), (1, 0.0, 50.0, 100.0, 50.0), (1, 0.0, 0.0, 0.0, 50.0), (1, 100.0, 0.0, 100.0, 50.0), (1, 40.0, 0.0, 40.0, 25.0), (1, 40.0, 25.0, 60.0, 25.0)]
    df = drawings(spark, [(*r, "#000000", 1.0, None) for r in rows])
    found = ruling.cells(ruling.corners(ruling.rulings(ruling.segments(df, ["page"]), ["page"]), ["page"]), ["page"])
    assert [tuple(r) for r in found.collect()] == [(1, 0.0, 0.0, 100.0, 50.0)]


def grid(page, x, y, columns, rows, skip=()):
    out = [(page, x, y + 20.0 * k, x + 40.0 * columns, y + 20.0 * k, "#000000", 1.0, None) for k in range(rows + 1)]
    for k in range(columns + 1):
        out += [(page, x + 40.0 * k, y + 20.0 * r, x + 40.0 * k, y + 20.0 * (r + 1), "#000000", 1.0, None) for r in range(rows) if (k, r) not in skip]
    return out


def test_tables_text_and_what_is_outside(spark):
    shapes = grid(1, 10.0, 10.0, 3, 3, {(1, 1), (2, 1)}) + grid(1, 300.0, 10.0, 2, 2) + [(2, 0.0, 0.0, 50.0, 50.0, "#000000", 1.0, None), (2, None, 1.0, 2.0, 3.0, None, None, None), (2, 9.0, 9.0, 5.0, 5.0, "#000000", 1.0, None)]
    shapes += grid(3, 0.0, 0.0, 2, 3, {(1, 0)})  # the head is one cell over the whole width
    spans = [(1, 0, 0, 0, "a", 12.0, 12.0, 20.0, 20.0), (1, 0, 0, 1, "b", 21.0, 12.0, 30.0, 20.0), (1, 0, 1, 0, "c", 12.0, 21.0, 20.0, 29.0), (1, 1, 0, 0, "wide", 60.0, 32.0, 80.0, 44.0), (1, 2, 0, 0, "out", 200.0, 100.0, 220.0, 110.0), (1, 3, 0, 0, None, None, None, None, None)]
    s = spark.createDataFrame(spans, f"page int, block_number int, line_index int, span_index int, text string, {BOX}")
    cells = ruling.page_tables(drawings(spark, shapes), s, ["page"])
    got = {(r.page, r.table_index, r.row_index, r.column_index): (r.row_span, r.column_span, r.text) for r in cells.collect()}
    assert got[1, 0, 0, 0] == (1, 1, "ab\nc") and got[1, 0, 1, 0] == (1, 3, "wide") and len([k for k in got if k[:2] == (1, 0)]) == 7
    assert len([k for k in got if k[:2] == (1, 1)]) == 4 and not [k for k in got if k[0] == 2]
    assert sorted(k for k in got if k[0] == 3) == [(3, 0, i, j) for i in range(2) for j in range(2)]
    one = {(r.page, r.table_index): (r.row_count, r.column_count, r.left, r.top, r.right, r.bottom) for r in ruling.summary(cells, ["page"]).collect()}
    assert one == {(1, 0): (3, 3, 10.0, 10.0, 130.0, 70.0), (1, 1): (2, 2, 300.0, 10.0, 380.0, 50.0), (3, 0): (2, 2, 0.0, 20.0, 80.0, 60.0)}
    out = ruling.outside(ruling.summary(cells, ["page"]), s, ["page"], ["table_index"], ["block_number", "line_index", "span_index"])
    assert sorted(str(r.text) for r in out.collect()) == ["None", "out"]
    assert ruling.page_tables(drawings(spark, []), s, ["page"]).count() == 0


def test_spans_with_equal_numbers(spark):
    """Two spans of equal numbers, one in a cell and one outside, or in two cells: each goes by its own box."""
    spans = [(1, 0, 0, 0, "in", 60.0, 12.0, 70.0, 20.0), (1, 0, 0, 0, "out", 200.0, 100.0, 220.0, 110.0), (1, 0, 0, 1, "second", 62.0, 32.0, 70.0, 40.0), (1, 0, 0, 1, "first", 72.0, 12.0, 80.0, 20.0), (1, None, 0, 2, "unnumbered", 12.0, 12.0, 20.0, 20.0)]
    s = spark.createDataFrame(spans, f"page int, block_number int, line_index int, span_index int, text string, {BOX}")
    cells = ruling.page_tables(drawings(spark, grid(1, 10.0, 10.0, 3, 3)), s, ["page"])
    assert {(r.row_index, r.column_index): r.text for r in cells.collect() if r.text and r.column_index} == {(0, 1): "infirst"}
    out = ruling.outside(ruling.summary(cells, ["page"]), s, ["page"], ["table_index"], ["block_number", "line_index", "span_index"])
    assert [r.text for r in out.collect()] == ["out"]


def test_strict_rulings_leave_out_fills(spark):
    df = drawings(spark, [(1, 0.0, 0.0, 50.0, 50.0, None, None, "#FF0000"), (1, 0.0, 0.0, 50.0, 50.0, "#000000", 1.0, None)])
    assert ruling.segments(df, ["page"]).count() == 8 and ruling.segments(df, ["page"], strict=True).count() == 4


def test_cells_snap_and_gaps_fill(spark):
    tables = spark.createDataFrame([(1, 2, 2, 0.0, 0.0, 80.0, 40.0, 0.9), (2, 2, 2, 0.0, 0.0, 80.0, 40.0, 0.9), (3, 1, 1, 0.0, 0.0, 9.0, 9.0, 0.9)], f"t int, row_count int, column_count int, {BOX}, confidence double")
    cell = lambda t, r, c, box, rs=1, cs=1: (t, r, c, rs, cs, *box, 0.8, False, True, f"{r}{c}", f"b{r}{c}")
    rows = [cell(1, 0, 0, (1.0, 0.0, 40.0, 20.0)), cell(1, 0, 1, (40.0, 0.0, 80.0, 20.0)), cell(1, 1, 0, (0.0, 20.0, 40.0, 34.0)), cell(2, 0, 0, (0.0, 0.0, 40.0, 20.0)), cell(2, 1, 1, (40.0, 20.0, 80.0, 40.0), 1, 2)]
    cells = spark.createDataFrame(rows, f"t int, row_index int, column_index int, row_span int, column_span int, {BOX}, confidence double, synthetic boolean, has_content boolean, text string, borders string")
    out = reconstruction.reconstructed(tables, cells, ["t"], ["row_index", "column_index"]).collect()
    got = {(r.t, r.row_index, r.column_index): r for r in sorted(out, key=lambda r: not r.synthetic)}
    assert (got[1, 0, 0].left, got[1, 0, 0].moved, got[1, 0, 0].far) == (0.0, 1.0, False)
    assert (got[1, 1, 0].bottom, got[1, 1, 0].moved, got[1, 1, 0].far) == (40.0, 6.0, True)
    blank = got[1, 1, 1]
    assert (blank.synthetic, blank.text, blank.borders, blank.confidence) == (True, "", "b00", 0.45) and (blank.left, blank.top, blank.right, blank.bottom) == (40.0, 20.0, 80.0, 40.0)
    assert got[2, 1, 1].moved is None and got[2, 1, 1].confidence == 0.8 and not got[2, 1, 1].synthetic
    grid_confidence = reconstruction.edges(tables, cells, ["t"]).where("t = 1").first().grid_confidence
    assert got[1, 0, 0].confidence == pytest.approx(0.56 + 0.3 * grid_confidence)
    final = {r.t: r for r in reconstruction.finalized(tables, cells, ["t"]).collect()}
    assert (final[1].synthetic_cells, final[1].disposition) == (1, "editable") and final[1].confidence == pytest.approx(0.405 + 0.35 * grid_confidence + 0.15)
    assert (final[2].disposition, final[3].disposition, final[3].confidence, final[3].synthetic_cells) == ("visual_fallback", "visual_fallback", 0.4, 0)


def test_tables_match_by_source_then_index(spark):
    items = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 8, 2), (1, "c", 9, 0), (1, "d", None, 2), (1, "e", 9, -1), (2, "f", 7, 0)], "page int, item_id string, source_id int, source_index int")
    tables = spark.createDataFrame([(1, "t0", 7, 0), (1, "t1", 7, 1), (1, "t2", None, 2)], "page int, table_id string, source_id int, table_index int")
    got = {r.item_id: (r.table_id, r.matched_by) for r in reconstruction.matched(items, tables, ["page"]).collect()}
    assert got == {"a": ("t0", "identity"), "b": ("t2", "index"), "c": (None, None), "d": ("t2", "index"), "e": (None, None), "f": (None, None)}


def test_ids_are_dense_over_pages(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice([None, *range(9)]), rng.random()) for d in (1, 2, None) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc int, page int, o double")
    got = numbering.dense_ids(df, "doc", "page", ["o"], "id", 1).collect()
    for d in (1, 2, None):
        mine = sorted((r for r in got if r.doc == d), key=lambda r: (r.page is not None, r.page or 0, r.o))
        assert [r.id for r in mine] == list(range(1, 41))


DEFS = "doc_id int, page_number int, run int, level int, kind string, format string, text string, left_twips int, hanging_twips int, start int"


def definitions(spark):
    number = lambda p, run, level, start=1, text=None: (1, p, run, level, "decimal", "decimal", text or f"%{level + 1}.", 720 + 360 * level, 360, start)
    return spark.createDataFrame([
        number(1, 1, 0, 3), number(1, 2, 0), (1, 2, 1, 0, "bullet", "bullet", "•", 720, 360, 1), number(2, 2, 2, 4), number(2, 2, 0, 2), number(3, 1, 0, 5, '<"&>'), (2, 1, 1, 0, "bullet", "bullet", "•", 720, 360, 1)], DEFS)


def test_numbering_ids_and_levels(spark):
    fonts = spark.createDataFrame([(1, 2, 1, "Wingdings-Regular", 10.3), (1, 1, 1, "Wingdings", 12.0)], "doc_id int, page_number int, run int, font string, font_size double")
    got = {(r.doc_id, r.page_number, r.run): r for r in numbering.instances(definitions(spark), "doc_id", "page_number", "run", fonts).collect()}
    assert {k: r.num_id for k, r in got.items()} == {(1, 1, 1): 1, (1, 1, 2): 2, (1, 2, 1): 3, (1, 2, 2): 4, (1, 3, 1): 5, (2, 1, 1): 1}
    assert {k: r.abstract_id for k, r in got.items()} == {(1, 1, 1): 0, (1, 1, 2): 1, (1, 2, 1): 2, (1, 2, 2): 3, (1, 3, 1): 4, (2, 1, 1): 0}
    one, bullet, deep = got[1, 1, 1], got[1, 2, 1], got[1, 2, 2]
    assert (one.levels[0].font, one.levels[0].half_points, bullet.levels[0].font, bullet.levels[0].half_points) == ("Wingdings", 24, "Arial", 21)
    assert [(v.level, v.format, v.text) for v in deep.levels] == [(0, "decimal", "%1."), (1, "lowerLetter", "%2."), (2, "decimal", "%3.")]
    assert [tuple(o) for o in deep.overrides] == [(0, 2), (2, 4)] and bullet.overrides == [] and [tuple(o) for o in one.overrides] == [(0, 3)]
    plain = {(r.page_number, r.run): (r.num_id, r.abstract_id, r.is_new) for r in numbering.instances(definitions(spark), "doc_id", "page_number", "run").where("doc_id = 1").collect()}
    assert plain == {(1, 1): (1, 0, True), (1, 2): (2, 0, False), (2, 1): (3, 1, True), (2, 2): (4, 2, True), (3, 1): (5, 3, True)}


def test_lists_continue(spark):
    rows = [(1, 1, "number", "1.", None, 10.0, 0.0, 12.0), (1, 2, "number", "2.", 20.0, 10.0, 20.0, 32.0), (1, 3, "number", "4.", None, 10.0, 40.0, 52.0), (1, 4, "bullet", "•", None, 10.0, 60.0, 72.0), (1, 5, "bullet", "•", None, 29.0, 80.0, 92.0), (1, 6, "bullet", "•", None, 29.0, 140.0, 152.0), (1, 7, None, None, None, 29.0, 153.0, 160.0)]
    df = spark.createDataFrame(rows, "page int, n int, list_type string, marker string, content_left double, left double, top double, bottom double")
    assert [r.n for r in numbering.continues(df, ["page"], ["n"]).where("continues").collect()] == [2]


def parts_of(blob):
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist()))
        return {n: z.read(n) for n in z.namelist()}


def package(spark, **more):
    items = [
        (1, 1, 1, "paragraph", "One <&> \x01two\nthree", "center", None, None, None), (1, 1, 2, "paragraph", "listed", "left", 1, 0, None), (1, 2, 3, "paragraph", None, "justify", 4, 2, None),
        (1, 3, 4, "image", None, None, None, None, "known"), (1, 3, 5, "image", None, None, None, None, "other"), (1, 3, 6, "image", None, None, None, None, "known"), (2, 1, 1, "paragraph", "alone", None, None, None, None)]
    df = spark.createDataFrame(items, "doc_id int, page_number int, render_order int, kind string, text string, alignment string, num_id int, level int, sha string")
    data = spark.createDataFrame([(1, "a", bytearray(b"png bytes"), ".PNG"), (1, "b", bytearray(b"png bytes"), "png"), (1, "c", None, "png"), (1, "d", bytearray(b""), "png"), (9, "e", bytearray(b"unused"), "gif")], "doc_id int, image string, data binary, ext string")
    shas = media.references(data)
    known = shas.where("image = 'a'").first().sha
    df = df.withColumn("sha", F.when(F.col("sha") == "known", known).otherwise(F.col("sha"))).withColumns({"right": F.lit(20.0), "left": F.lit(0.0), "top": F.lit(5.0), "bottom": F.lit(15.0), "data": F.lit("clash")})
    kept = media.media_bytes(data, media.media(data, "doc_id", ["image"]), ["image"])
    assert sorted((r.doc_id, r.image, r.refs, r.ext) for r in kept.collect()) == [(1, "a", 2, "png"), (9, "e", 1, "gif")]
    assert sorted(tuple(r) for r in media.missing(data, "doc_id").collect()) == [(1, 4, 2), (9, 1, 0)]
    numbers = numbering.instances(definitions(spark), "doc_id", "page_number", "run")
    sections = spark.createDataFrame([(1, 1, 2, 612.0, 792.0), (1, 2, 3, 792.0, 612.0)], "doc_id int, section int, last_page int, width double, height double").withColumns({f"margin_{s}": F.lit(36.0) for s in ("left", "top", "right", "bottom")})
    field = "struct<prefix:string,separator:string,suffix:string,has_total:boolean>"
    told = spark.createDataFrame([(1, 1, "header", 1, "Report & Co", "left", None), (1, 1, "footer", 1, "Page 1 of 9", "center", ("Page ", " of ", "", True))], f"doc_id int, section int, story string, story_order int, text string, alignment string, field {field}")
    return {r.doc_id: r for r in word.packages(df, "doc_id", sections, told, numbers, kept, **more).collect()}, known


def test_package_parts(spark):
    got, known = package(spark)
    assert sorted(got) == [1, 2] and (got[1].pictures, got[1].missing_pictures, got[2].pictures) == (2, 1, 0)
    parts = parts_of(got[1].docx)
    assert list(parts) == got[1].parts and [n for n in parts if "media" in n] == [f"word/{word.media_name(known, 'png')}"] and parts[f"word/{word.media_name(known, 'png')}"] == b"png bytes"
    xml = {n: ElementTree.fromstring(p) for n, p in parts.items() if n.endswith((".xml", ".rels"))}
    body = xml["word/document.xml"].find(f"{W}body")
    texts = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p")]
    assert texts[:2] == ["One <&> twothree", "listed"]
    assert [(n.find(f"{W}ilvl").get(f"{W}val"), n.find(f"{W}numId").get(f"{W}val")) for n in body.iter(f"{W}numPr")] == [("0", "1"), ("2", "4")]
    sizes = [(s.find(f"{W}pgSz").get(f"{W}w"), s.find(f"{W}pgSz").get(f"{W}orient")) for s in body.iter(f"{W}sectPr")]
    assert sizes == [("12240", None), ("15840", "landscape")] and body[-1].tag == f"{W}sectPr"
    rels = {r.get("Id"): r.get("Target") for r in xml["word/_rels/document.xml.rels"]}
    used = {e.get(f"{R}id") for e in body.iter() if e.get(f"{R}id")} | {e.get(f"{R}embed") for e in body.iter() if e.get(f"{R}embed")}
    assert used <= set(rels) and all(f"word/{t}" in parts for t in rels.values())
    heads = [[(e.tag.removeprefix(W), rels[e.get(f"{R}id")]) for e in s if e.get(f"{R}id")] for s in body.iter(f"{W}sectPr")]
    assert heads == [[("headerReference", "header1.xml"), ("footerReference", "footer1.xml")], [("headerReference", "headerEmpty.xml"), ("footerReference", "footerEmpty.xml")]]
    assert "".join(t.text for t in xml["word/header1.xml"].iter(f"{W}t")) == "Report & Co"
    assert [t.text.strip() for t in xml["word/footer1.xml"].iter(f"{W}instrText")] == ["PAGE", "NUMPAGES"] and "".join(t.text for t in xml["word/footer1.xml"].iter(f"{W}t")) == "Page 1 of 1"
    types = {e.get("PartName") or e.get("Extension"): e.get("ContentType") for e in xml["[Content_Types].xml"]}
    assert types["png"] == "image/png" and all(f"/{n}" in types for n in parts if n.startswith("word/") and n.endswith(".xml"))
    numbers = xml["word/numbering.xml"]
    assert [e.tag.removeprefix(W) for e in numbers] == ["abstractNum"] * 4 + ["num"] * 5
    assert [(n.get(f"{W}numId"), n.find(f"{W}abstractNumId").get(f"{W}val")) for n in numbers.iter(f"{W}num")] == [("1", "0"), ("2", "0"), ("3", "1"), ("4", "2"), ("5", "3")]
    assert [t.get(f"{W}val") for t in numbers.iter(f"{W}lvlText")][-1] == '<"&>'
    assert [o.get(f"{W}val") for o in numbers.iter(f"{W}startOverride")] == ["3", "1", "2", "4", "5"]
    alone = parts_of(got[2].docx)
    assert "word/numbering.xml" in alone and not [n for n in alone if "header" in n] and b"alone" in alone["word/document.xml"]


def test_fixed_package(spark):
    got, known = package(spark, fixed=True)
    body = ElementTree.fromstring(parts_of(got[1].docx)["word/document.xml"])
    v = f"{{{word._NAMES['v']}}}"
    assert len(list(body.iter(f"{v}imagedata"))) == 2 and "margin-top:5.00pt" in next(body.iter(f"{v}shape")).get("style")


def test_package_streams_batches(spark):
    """A document over many batches and one without any item of its own."""
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("doc_id"), (F.col("id") / 500).cast("int").alias("page_number"), F.col("id").alias("render_order"), F.col("id").cast("string").alias("text"))
    told = spark.createDataFrame([(7, 1, "header", 1, "no items", "left")], "doc_id int, section int, story string, story_order int, text string, alignment string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.docx for r in word.packages(df, "doc_id", stories=told).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == [0, 1, 2]
    for k, blob in got.items():
        body = ElementTree.fromstring(parts_of(blob)["word/document.xml"])
        assert [t.text for t in body.iter(f"{W}t")] == [str(x) for x in range(k, 3000, 3)]


def test_sections_stories_and_margins(spark):
    p = spark.createDataFrame([(1, n, w, 792.0, r) for n, w, r in ((1, 612.0, 0), (2, 612.001, 360), (3, 612.0, 0), (4, 700.0, 0))] + [(2, 1, 612.0, 792.0, None)], "doc int, page int, width double, height double, rotation int")
    text = [(1, n, k, role, t, "left", 30.0 + n, 12.0 * k) for n in (1, 2, 3, 4) for k, role, t in ((1, "header", "The  Report" if n < 3 else "Other"), (2, "body", "x"), (3, "footer", f" Page {n} of 9 "))]
    par = spark.createDataFrame(text, "doc int, page int, reading_order int, role string, text string, alignment string, left double, top double")
    paged = stories.page_sections(p, par, "doc", "page")
    assert [(r.doc, r.page, r.section) for r in paged.orderBy("doc", "page").collect()] == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1)]
    bodies = spark.createDataFrame([(1, 1, 5.0, 70.0), (1, 2, 50.0, 60.0)], "doc int, page int, left double, top double")
    got = {(r.doc, r.section): r for r in stories.sections(paged, bodies, par, "doc", "page").collect()}
    assert (got[1, 1].first_page, got[1, 1].last_page, got[1, 1].margin_left, got[1, 1].margin_top) == (1, 2, 18.0, 60.0)
    assert (got[1, 2].margin_left, got[1, 2].margin_top, got[2, 1].margin_left, got[2, 1].rotation) == (33.0, 18.0, 36.0, 0)
    told = [(r.section, r.story, r.text, r.field and (r.field.prefix, r.field.has_total)) for r in stories.stories(paged, par, "doc", "page").orderBy("section", "story").collect()]
    assert told[:2] == [(1, "footer", "Page 1 of 9", ("Page ", True)), (1, "header", "The  Report", None)] and len(told) == 6


def test_headings_of_regions(spark):
    regions = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [3]), (1, 3, []), (1, 4, None)], "page int, region int, source_block_numbers array<int>")
    blocks = spark.createDataFrame([(1, 2, "heading"), (1, 2, "subtitle"), (1, 3, "paragraph")], "page int, block_number int, block_type string")
    assert [tuple(r) for r in stories.headings(regions, blocks, ["page"], "region").collect()] == [(1, 1)]


def test_tables_from_decoded_pages(spark, tmp_path):
    """From a page's JSON to cells with text, as a reader of files goes."""
    import json

    line = lambda x0, y0, x1, y1: {"type": "s", "rect": [x0, y0, x1, y1], "color": [0, 0, 0], "width": "1", "items": ["l"]}
    drawn = [line(0, y, 80, y) for y in (0, 20, 40)] + [line(x, 0, x, 40) for x in (0, 40, 80)]
    span = lambda t, x, y: {"text": t, "font": "A", "size": 9.0, "color": 0, "flags": 0, "bbox": [x, y, x + 8, y + 8], "origin": [x, y + 8]}
    page = {"doc_id": 4, "page_number": 1, "width": 612, "height": 792, "rotation": 0, "drawings": drawn, "blocks": [{"type": 0, "number": 0, "lines": [{"spans": [span("in", 5, 5)]}, {"spans": [span("cell", 45, 25)]}, {"spans": [span("out", 200, 5)]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    read = pages.read_pages(spark, str(tmp_path / "p.json"))
    got = ruling.page_tables(pages.vectors(read), pages.spans(read), ["doc_id", "page_number"])
    assert sorted((r.row_index, r.column_index, r.text) for r in got.collect()) == [(0, 0, "in"), (0, 1, ""), (1, 0, ""), (1, 1, "cell")]
