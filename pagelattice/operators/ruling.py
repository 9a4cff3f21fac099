"""Tables from ruling lines: segments, corners, lattice cells, tables with indices, text and outside items.

Everything is keyed by page. Crossings come from a sorted sweep that gives each horizontal line the
stretch of vertical ones it spans; cells from the next corner to the right and below and the place where
these would close. What meets at a rank or a place does so as a group of it, not by joins, so that lines dealt
by page are dealt once, over as many partitions as the caller chooses. Items meet cells by squares of the page.
None of them compares all pairs of a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box
from pagelattice.operators.grouped import map_groups
from pagelattice.operators.styles import without_wrappers

#: Points within which lines are one, ends meet and crossings count; the shortest line, the thickest bar.
SNAP, JOIN, CROSS, SHORTEST, THICKEST = 3.0, 3.0, 3.0, 3.0, 3.0
#: Side of the squares in which items and cells meet; the share of a table's width that makes a wrapper row.
SQUARE, WRAPPER = 48.0, 0.9


def _d(x: float):
    return F.lit(float(x))


def segments(drawings: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rulings of drawings (box, stroke_color, stroke_width, fill_color): keys, horizontal, at, start, end.

    A bar of up to THICKEST points is a line along its middle; of larger painted rectangles all four
    edges count, with strict only if they are stroked. Drawings without a finite box give none.
    """
    b = Box.of()
    finite = F.coalesce(F.abs(b.left) + F.abs(b.right) + F.abs(b.top) + F.abs(b.bottom) < float("inf"), F.lit(False))
    stroked = F.col("stroke_color").isNotNull() & (F.coalesce("stroke_width", _d(0)) > 0)
    painted = stroked if strict else stroked | F.col("fill_color").isNotNull()
    one = lambda horizontal, at, start, end: F.struct(F.lit(horizontal).alias("horizontal"), at.alias("at"), start.alias("start"), end.alias("end"))
    flat = F.array(one(True, b.center_y, b.left, b.right))
    upright = F.array(one(False, b.center_x, b.top, b.bottom))
    frame = F.array(one(True, b.top, b.left, b.right), one(True, b.bottom, b.left, b.right), one(False, b.left, b.top, b.bottom), one(False, b.right, b.top, b.bottom))
    found = F.when((b.height <= THICKEST) & (b.width > b.height), flat).when(b.width <= THICKEST, upright).when(painted, frame)
    ok = finite & (b.width >= 0) & (b.height >= 0)
    return drawings.where(ok).select(*keys, F.inline(found))


def rulings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with those of nearly the same position at their mean, and joined where they meet:
    keys, horizontal, line (rank of the position), seg, at, start, end."""
    side = [*keys, "horizontal"]
    w = Window.partitionBy(*side).orderBy("at")
    s = lines.where("end >= start").withColumn("_new", F.when(F.col("at") - F.lag("at").over(w) <= SNAP, 0).otherwise(1))
    s = s.withColumn("line", F.sum("_new").over(w))  # equal positions are peers, so they are on one line
    v = Window.partitionBy(*side, "line").orderBy("start", "end")
    reach = F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1))
    mean = F.avg("at").over(v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumns({"at": mean, "_new": F.when(F.col("start") <= reach + JOIN, 0).otherwise(1)})
    s = s.withColumn("_part", F.sum("_new").over(v))
    joined = s.groupBy(*side, "line", "_part").agg(F.min("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"))
    seg = F.shiftleft(F.col("line").cast("long"), 32) + F.col("_part")
    return joined.where(F.col("end") - F.col("start") >= SHORTEST).select(*side, "line", seg.alias("seg"), "at", "start", "end")


def corners(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Crossings of rulings(): keys, h, v (the segments), x, y.

    One sorted pass over the vertical segments and the ends of horizontal ones tells each of the latter the
    ranks of the segments between its ends, and both meet as the group of a rank.
    """
    mark = lambda pos, kind: F.struct(pos.alias("pos"), F.lit(kind).alias("kind"))
    ends = F.array(mark(F.col("start") - CROSS, 0), mark(F.col("end") + CROSS, 2))
    one = [*keys, "horizontal", "seg", "at", "start", "end"]
    marks = lines.dropna(subset=keys).select(*one, F.inline(F.when(F.col("horizontal"), ends).otherwise(F.array(mark(F.col("at"), 1)))))
    w = Window.partitionBy(*keys).orderBy("pos", "kind", "seg").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.withColumn("seen", F.count_if(F.col("kind") == 1).over(w))
    # segments seen by the end, less those seen by the start, lie between; an upright one is the last of those seen with it
    spans = swept.groupBy(*one).agg(F.min("seen").alias("low"), F.max("seen").alias("high"))
    ranks = F.when(~F.col("horizontal"), F.array("low")).when(F.col("low") < F.col("high"), F.sequence(F.col("low") + 1, F.col("high")))
    across, down = F.struct(F.col("seg").alias("h"), F.col("at").alias("y")), F.struct(F.col("seg").alias("v"), F.col("at").alias("x"), "start", "end")
    reached = spans.select(*one, F.explode(ranks).alias("rank")).groupBy(*keys, "rank").agg(
        F.first(F.when(~F.col("horizontal"), down), True).alias("_v"), F.collect_list(F.when(F.col("horizontal"), across)).alias("_h"))
    met = reached.select(*keys, "_v.*", F.inline("_h")).where(F.col("y").between(F.col("start") - CROSS, F.col("end") + CROSS))
    return met.select(*keys, "h", "v", "x", "y")


def _asked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (own, and q: places h, v), once for each place asked, with at: x and y of the corner that is there. A corner
    asks for itself and has closed null."""
    own = ["h", "v", "x", "y", "right", "bottom", "closed"]
    met = rows.groupBy(*keys, "q").agg(F.first(F.when(F.col("closed").isNull(), F.struct("x", "y")), True).alias("at"), F.collect_list(F.struct(*own)).alias("of"))
    return met.select(*keys, "at", F.inline("of"))


def _beyond(rows: DataFrame, keys: list[str], line: str, by: str, other: str, name: str) -> DataFrame:
    """rows with name: for those not closed, the other lines that cross theirs beyond them."""
    own = [c for c in rows.columns if c not in keys]
    met = rows.groupBy(*keys, line).agg(F.collect_list(F.when(F.col("closed").isNull(), F.struct(by, other))).alias("line"), F.collect_list(F.struct(*own)).alias("of"))
    found = lambda o: F.when(~o["closed"], F.transform(F.filter("line", lambda p: p[by] > o[by]), lambda p: p[other]))
    return met.select(*keys, F.inline(F.transform("of", lambda o: F.struct(*(o[c].alias(c) for c in own), found(o).alias(name)))))


def cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest closed rectangle right and below each corner: keys, left, top, right, bottom.

    Its sides run along lines from corner to corner; of several the one with the nearest bottom, then the
    nearest right side, counts. Mostly these are the next corner on the line from which another line goes down
    and the next below from which one goes right; where those two don't close, all others are tried.
    """
    before = lambda line, by: Window.partitionBy(*keys, line).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    along, upright = before("h", "x"), before("v", "y")
    c = points.dropna(subset=keys).withColumn("_right", F.max("x").over(along) > F.col("x"))
    c = c.withColumns({"_down": F.max("y").over(upright) > F.col("y"), "_b": F.last(F.when(F.col("_right"), F.struct("y", "h")), True).over(upright)})
    c = c.withColumn("_r", F.last(F.when(F.col("_down"), F.struct("x", "v")), True).over(along))
    place = lambda h, v: F.struct(h.alias("h"), v.alias("v"))
    ask = lambda q, right, bottom, closed: F.struct(q.alias("q"), right.cast("double").alias("right"), bottom.cast("double").alias("bottom"), closed.cast("boolean").alias("closed"))
    none, own = F.lit(None), place(F.col("h"), F.col("v"))
    next_two = F.when(F.col("_r").isNotNull() & F.col("_b").isNotNull(), F.array(ask(place(F.col("_b.h"), F.col("_r.v")), F.col("_r.x"), F.col("_b.y"), F.lit(False))))
    asks = F.concat(F.array(ask(own, none, none, none)), F.coalesce(next_two, F.array()))
    first = _asked(c.select(*keys, "h", "v", "x", "y", F.inline(asks)), keys)
    closes = F.col("at").isNotNull() & (F.col("right") > F.col("x")) & (F.col("bottom") > F.col("y"))
    first = first.withColumn("closed", F.when(F.col("closed").isNotNull(), closes)).drop("at")
    wider = _beyond(_beyond(first, keys, "h", "x", "v", "_rights"), keys, "v", "y", "h", "_belows")
    every = F.flatten(F.transform("_rights", lambda v: F.transform("_belows", lambda h: place(h, v))))
    wider = wider.withColumn("q", F.explode(F.when(F.col("closed") == False, every).otherwise(F.array(own)))).drop("_rights", "_belows")  # noqa: E712
    found = _asked(wider, keys).where("closed or (not closed and at is not null)")
    to = F.when(F.col("closed"), F.struct("bottom", "right")).otherwise(F.struct(F.col("at.y").alias("bottom"), F.col("at.x").alias("right")))
    best = found.groupBy(*keys, "x", "y").agg(F.min(to).alias("to"))
    return best.select(*keys, F.col("x").alias("left"), F.col("y").alias("top"), F.col("to.right").alias("right"), F.col("to.bottom").alias("bottom"))


def tables(found: DataFrame, keys: list[str], deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cells of tables: keys, table_index, row_index, column_index, row_span, column_span, box.

    Cells that share a corner are of one table, and a table has at least two. Tables are numbered from 0 by their
    first cell from the top and the left; rows are the distinct tops of its cells, columns the distinct left
    edges. Leading and trailing rows of a single cell over nearly the whole width are text that was
    taken in, and go. deal, if given, deals rows by keys (see map_groups).
    """
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "left double", "top double", "right double", "bottom double", "table_index int"])

    def joined(rows):
        root, at = list(range(len(rows))), {}

        def find(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for k, r in enumerate(rows):
            for corner in ((r["left"], r["top"]), (r["right"], r["top"]), (r["left"], r["bottom"]), (r["right"], r["bottom"])):
                other = find(at.setdefault(corner, k))
                root[max(other, find(k))] = min(other, find(k))
        size: dict[int, int] = {}
        for k in range(len(rows)):
            size[find(k)] = size.get(find(k), 0) + 1
        number = {k: n for n, k in enumerate(k for k in size if size[k] > 1)}
        for k, r in enumerate(rows):
            if find(k) in number:
                yield {**r, "table_index": number[find(k)]}

    own = [*keys, "table_index"]
    c = map_groups(found.select(*keys, "left", "top", "right", "bottom"), keys, ["top", "left"], joined, schema, deal)
    c = deal(c) if deal else c
    t = Window.partitionBy(*own)
    lone = (F.count("*").over(Window.partitionBy(*own, "top")) == 1) & (F.col("right") - F.col("left") >= WRAPPER * F.greatest(F.max("right").over(t) - F.min("left").over(t), F.lit(1.0)))
    c = without_wrappers(c, own, "top", lone)
    tops, lefts = (F.array_sort(F.collect_set(x).over(t)) for x in ("top", "left"))
    c = c.withColumns({"_tops": tops, "_lefts": lefts})
    index = lambda edges, low: (F.array_position(edges, F.col(low)) - 1).cast("int")
    span = lambda edges, low, high: F.size(F.filter(edges, lambda e: (e >= F.col(low)) & (e < F.col(high)))).cast("int")
    return c.select(
        *own, index("_tops", "top").alias("row_index"), index("_lefts", "left").alias("column_index"), span("_tops", "top", "bottom").alias("row_span"), span("_lefts", "left", "right").alias("column_span"),
        "left", "top", "right", "bottom")


def summary(table_cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table of tables(): keys, table_index, row_count, column_count, cells, box."""
    return table_cells.groupBy(*keys, "table_index").agg(
        (F.max("row_index") + 1).alias("row_count"), (F.max("column_index") + 1).alias("column_count"), F.count("*").alias("cells"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def _squares(df: DataFrame, b: Box, tolerance: float) -> DataFrame:
    """df once for each square of the page that its box, widened by the tolerance, touches."""
    to = lambda x: F.floor(x / SQUARE).cast("int")
    df = df.withColumn("_sx", F.explode(F.sequence(to(b.left - tolerance), to(b.right + tolerance))))
    return df.withColumn("_sy", F.explode(F.sequence(to(b.top - tolerance), to(b.bottom + tolerance))))


def holders(boxes: DataFrame, items: DataFrame, keys: list[str], box_id: list[str], item_id: list[str], tolerance: float = 0.0, also: tuple[str, ...] = ()) -> DataFrame:
    """keys, item_id, box_id and also: for each item (box) the one of boxes that holds its centre; of several the one with the
    smallest box_id. Items meet boxes in squares of the page. Items without a box are in none. Of items with one item_id
    that in the smallest box_id counts, and in one box the smallest by the further columns in also."""
    b, i = Box.of(), Box.of()
    on = Box(*(F.col(f"b.{n}") for n in ("left", "top", "right", "bottom")))
    spread = _squares(boxes.select(*keys, F.struct(*box_id).alias("_id"), b.struct().alias("b")).where((on.right >= on.left) & (on.bottom >= on.top)), on, tolerance)
    at = items.select(*keys, *item_id, *also, i.center_x.alias("_x"), i.center_y.alias("_y")).where(F.coalesce(F.abs(F.col("_x")) + F.abs(F.col("_y")) < float("inf"), F.lit(False)))
    at = at.withColumns({"_sx": F.floor(F.col("_x") / SQUARE).cast("int"), "_sy": F.floor(F.col("_y") / SQUARE).cast("int")})
    inside = F.col("_x").between(on.left - tolerance, on.right + tolerance) & F.col("_y").between(on.top - tolerance, on.bottom + tolerance)
    hits = at.join(spread, [*keys, "_sx", "_sy"]).where(inside)
    return hits.groupBy(*keys, *item_id).agg(F.min(F.struct("_id", *also)).alias("_of")).select(*keys, *item_id, "_of._id.*", *(f"_of.{c}" for c in also))


def with_text(table_cells: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """table_cells with text: the spans whose centre a cell holds, in lines by block and line, '' where there are
    none. spans: block_number, line_index, span_index, text and a box; one of equal numbers counts (see holders)."""
    own, of = ["table_index", "row_index", "column_index"], ["block_number", "line_index", "span_index"]
    held = holders(table_cells, spans, keys, own, of, also=("left", "text"))
    lines = held.groupBy(*keys, *own, "block_number", "line_index").agg(F.array_sort(F.collect_list(F.struct("left", "span_index", "text"))).alias("s"))
    lines = lines.select(*keys, *own, "block_number", "line_index", F.array_join(F.col("s.text"), "").alias("line"))
    texts = lines.groupBy(*keys, *own).agg(F.array_sort(F.collect_list(F.struct("block_number", "line_index", "line"))).alias("l"))
    texts = texts.select(*keys, *own, F.trim(F.array_join(F.col("l.line"), "\n")).alias("text"))
    return table_cells.join(texts, [*keys, *own], "left").na.fill("", ["text"])


def outside(boxes: DataFrame, items: DataFrame, keys: list[str], box_id: list[str], item_id: list[str], tolerance: float = 1.5) -> DataFrame:
    """The items whose centre no box holds: paragraph building and the export of text boxes leave out
    what stands in tables. Items without a box stay. Each row goes by its own centre, whatever its item_id, which several
    may have."""
    i, at = Box.of(), ["_cx", "_cy"]
    placed = items.withColumns({"_cx": i.center_x, "_cy": i.center_y})
    held = holders(boxes, placed, keys, box_id, at, tolerance)
    return placed.join(held.select(*keys, *at), [*keys, *at], "left_anti").drop(*at)


def page_tables(drawings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with text of all tables that drawings rule on each page."""
    return with_text(tables(cells(corners(rulings(segments(drawings, keys), keys), keys), keys), keys), spans, keys)
