"""Borders of cells edge by edge, and the grid lines of a fixed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, overlap_x, overlap_y
from pagelattice.operators.ruling import _squares
from pagelattice.operators.styles import border_style, merged_segments

#: Points that a line may be off a cell's edge, the thickest border, the share of the edge that it must follow.
TOLERANCE, THICKEST, FOLLOWS = 2.5, 3.5, 0.45
#: Points: the thinnest line that shows, and what is level.
THINNEST, LEVEL = 0.75, 0.5
EDGES = ("top", "right", "bottom", "left")


def edge_border(b: Box, stroke_color: Column, stroke_width: Column, fill_color: Column, dashes: Column) -> Column:
    """struct(width, style, color) of a drawing as a border: its stroke, or a thin fill; else null."""
    width = F.greatest(F.coalesce(stroke_width, F.lit(0.0)), F.lit(0.0))
    short = F.least(F.greatest(b.width, F.lit(0.0)), F.greatest(b.height, F.lit(0.0)))
    of = lambda w, c: F.struct(w.alias("width"), border_style(dashes).alias("style"), c.alias("color"))
    return F.when(width > 0, of(F.least(width, F.lit(THICKEST)), F.coalesce(stroke_color, F.lit("000000")))).when(fill_color.isNotNull() & (short <= THICKEST), of(F.greatest(short, F.lit(0.1)), fill_color))


def cell_borders(cells: DataFrame, drawings: DataFrame, keys: list[str], cell_id: list[str]) -> DataFrame:
    """keys, cell_id, edge, width, style, color: the widest border that lies on each edge of each cell, the first by ordinal
    of equal ones. Edges without one have no row, so that the table's own border holds.

    A rectangle drawn as the cell is on all four edges. Others are lines: level or upright ones whose middle is on
    the edge and that follow at least 0.45 of it. cells and drawings have boxes; drawings ordinal, drawing_type, stroke_color,
    stroke_width, fill_color and dashes. They meet in squares of the page.
    """
    c, d = (Box(*(F.col(f"{p}.{n}") for n in ("left", "top", "right", "bottom"))) for p in "cd")
    solid = lambda b: (b.right >= b.left) & (b.bottom >= b.top)
    box = Box.of()
    left = _squares(cells.select(*keys, *cell_id, box.struct().alias("c")).where(solid(c)), c, TOLERANCE)
    border = edge_border(box, F.col("stroke_color"), F.col("stroke_width"), F.col("fill_color"), F.col("dashes"))
    drawn = drawings.select(*keys, "ordinal", box.struct().alias("d"), border.alias("border"), F.lower("drawing_type").alias("kind"), F.coalesce("stroke_width", F.lit(0.0)).alias("stroke")).where("border is not null")
    met = left.join(_squares(drawn.where(solid(d)), d, 0.0), [*keys, "_sx", "_sy"])
    near = lambda a, b: F.abs(a - b) <= TOLERANCE
    same = F.coalesce(F.col("kind") == "rectangle", F.lit(False)) & near(d.left, c.left) & near(d.top, c.top) & near(d.right, c.right) & near(d.bottom, c.bottom)
    thin = lambda size: (size <= THICKEST) | (size <= F.col("stroke") + TOLERANCE)
    level = thin(d.height) & (overlap_x(d, c) / F.greatest(c.width, F.lit(1.0)) >= FOLLOWS)
    upright = thin(d.width) & (overlap_y(d, c) / F.greatest(c.height, F.lit(1.0)) >= FOLLOWS)
    on = {"top": level & near(d.center_y, c.top), "bottom": level & near(d.center_y, c.bottom), "left": upright & near(d.center_x, c.left), "right": upright & near(d.center_x, c.right)}
    hit = F.filter(F.array(*(F.when(same | on[e], F.lit(e)) for e in EDGES)), lambda e: e.isNotNull())
    each = met.select(*keys, *cell_id, F.explode(hit).alias("edge"), F.struct("border.width", (-F.col("ordinal")).alias("first"), "border.style", "border.color").alias("b"))
    best = each.groupBy(*keys, *cell_id, "edge").agg(F.max("b").alias("b"))  # a pair that shares several squares counts once
    return best.select(*keys, *cell_id, "edge", "b.width", "b.style", "b.color")


def with_borders(cells: DataFrame, found: DataFrame, keys: list[str], cell_id: list[str], width: float = 0.5, style: str = "single", color: str = "B7B7B7") -> DataFrame:
    """cells with borders, an array of (side, style, width, color) of all four edges, as the writer takes them: those
    found by cell_borders(), and the given one elsewhere."""
    by = found.groupBy(*keys, *cell_id).agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("style", "width", "color")))).alias("_by"))
    own = lambda e: F.coalesce(F.try_element_at(F.col("_by"), F.lit(e)), F.struct(F.lit(style).alias("style"), F.lit(width).alias("width"), F.lit(color).alias("color")))
    sides = F.array(*(F.struct(F.lit(e).alias("side"), own(e)["style"].alias("style"), own(e)["width"].alias("width"), own(e)["color"].alias("color")) for e in EDGES))
    return cells.join(by, [*keys, *cell_id], "left").withColumn("borders", sides).drop("_by")


def grid_lines(cells: DataFrame, keys: list[str], thickness: Column) -> DataFrame:
    """Every line of a table's grid once, as a thin box: keys, left, top, width, height in points to two places.

    The edges of all cells are joined where they lie on one line and meet. Lines thinner than 0.75 points
    wouldn't show. thickness is a column of cells, alike for a table (keys).
    """
    one = lambda level, at, start, end: F.struct(F.lit(level).alias("level"), at.alias("at"), start.alias("start"), end.alias("end"))
    b = Box.of()
    each = cells.select(*keys, F.inline(F.array(one(True, b.top, b.left, b.right), one(True, b.bottom, b.left, b.right), one(False, b.left, b.top, b.bottom), one(False, b.right, b.top, b.bottom))))
    lines = merged_segments(each, [*keys, "level"], LEVEL)
    own = cells.groupBy(*keys).agg(F.greatest(F.max(thickness), F.lit(THINNEST)).alias("_t"))
    t, level, length = F.col("_t"), F.col("level"), F.greatest(F.col("end") - F.col("start"), F.col("_t"))
    two = lambda x: F.round(x, 2)
    return lines.join(own, keys).select(
        *keys, two(F.when(level, F.col("start")).otherwise(F.col("at") - t / 2)).alias("left"), two(F.when(level, F.col("at") - t / 2).otherwise(F.col("start"))).alias("top"),
        two(F.when(level, length).otherwise(t)).alias("width"), two(F.when(level, t).otherwise(length)).alias("height"))
