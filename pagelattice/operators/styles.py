"""Cell and table styles: alignment, padding, borders, fills and header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, intersection_area, touches

BORDER, DEFAULT_BORDER, DEFAULT_WIDTH = (0.1, 3.0), "#B7B7B7", 0.5


def _d(x: float) -> Column:
    return F.lit(float(x))


def clamp_padding(c: Column) -> Column:
    return F.least(F.greatest(c, _d(0.5)), _d(12))


def cell_alignment(cell: Box, content: Box, font: Column, justified: Column) -> tuple[Column, Column]:
    """Horizontal and vertical alignment of a cell's content by its gaps."""
    gaps = [F.greatest(x, _d(0)) for x in (content.left - cell.left, cell.right - content.right, content.top - cell.top, cell.bottom - content.bottom)]
    left, right, top, bottom = gaps
    tolerance = F.greatest(_d(2.5), font * 0.35)
    across = (
        F.when(justified, "justify").when((F.abs(left - right) <= tolerance) & (F.least(left, right) >= 0.5), "center")
        .when((right + tolerance < left) & (right <= F.greatest(_d(6), cell.width * 0.2)), "right").otherwise("left"))
    down = F.when(F.abs(top - bottom) <= tolerance, "center").when((bottom + tolerance < top) & (bottom <= F.greatest(_d(6), cell.height * 0.2)), "bottom").otherwise("top")
    return across, down


def fixed_alignment(cell: Box, content: Box) -> tuple[Column, Column]:
    """Alignment in the fixed layout: of one line across, and of all lines down."""
    left, right = F.greatest(content.left - cell.left, _d(0)), F.greatest(cell.right - content.right, _d(0))
    top, bottom = F.greatest(content.top - cell.top, _d(0)), F.greatest(cell.bottom - content.bottom, _d(0))
    share = F.when(left > 0, left / F.greatest(left + right, _d(1))).otherwise(_d(0))
    across = F.when((left >= 4) & (right >= 4) & (F.abs(left - right) <= 4), "center").when((right <= 4) & (share >= 0.65), "right").otherwise("left")
    return across, F.when(F.abs(top - bottom) <= 3, "center").when(top > bottom + 3, "bottom").otherwise("top")


def paddings(cells: DataFrame, keys: list[str], cell: Box, content: Box) -> DataFrame:
    """cells with pad_left..pad_bottom: the gap on the aligned side, the table's median elsewhere.

    Needs horizontal and vertical. Cells without content take the medians, defaults 3 and 2.
    """
    w = Window.partitionBy(*keys)
    gap = lambda x: F.greatest(x, _d(0))
    left, right, top, bottom = gap(content.left - cell.left), gap(cell.right - content.right), gap(content.top - cell.top), gap(cell.bottom - content.bottom)
    across, down = (F.when(content.left.isNotNull(), F.least(a, b)) for a, b in ((left, right), (top, bottom)))
    c = cells.withColumns({"_h": clamp_padding(F.coalesce(F.median(across).over(w), _d(3))), "_v": clamp_padding(F.coalesce(F.median(down).over(w), _d(2)))})
    h, v, has = F.col("horizontal"), F.col("vertical"), content.left.isNotNull()
    side = lambda mine, gap_, both, base: F.when(has & mine, clamp_padding(gap_)).when(has & both[0], clamp_padding(both[1])).otherwise(F.col(base))
    mid_h, mid_v = (h == "center", F.least(left, right)), (v == "center", F.least(top, bottom))
    return c.withColumns({
        "pad_left": side(h.isin("left", "justify"), left, mid_h, "_h"), "pad_right": side(h == "right", right, mid_h, "_h"),
        "pad_top": side(v == "top", top, mid_v, "_v"), "pad_bottom": side(v == "bottom", bottom, mid_v, "_v")}).drop("_h", "_v")


def border_candidate(b: Box, stroke: Column, width: Column, fill: Column, fill_is_white: Column) -> Column:
    """struct(color, thickness) of a drawing that may be a border, else null: a stroke of up to 3, or a
    thin filled bar that isn't white."""
    short, long = F.least(b.width, b.height), F.greatest(b.width, b.height)
    stroked = stroke.isNotNull() & (width > 0)
    bar = fill.isNotNull() & (long / F.greatest(short, _d(0.001)) >= 4) & (short <= BORDER[1]) & ~fill_is_white
    return F.when((b.width > 0) & (b.height > 0), F.when(stroked, F.when(width <= BORDER[1], F.struct(stroke.alias("color"), width.alias("thickness")))).when(bar, F.struct(fill.alias("color"), short.alias("thickness"))))


def border_style(dash: Column) -> Column:
    d = F.lower(F.coalesce(dash, F.lit("")))
    return F.when(d.contains("dot"), "dotted").when(~d.isin("", "[] 0", "none"), "dashed").otherwise("single")


def table_borders(tables: DataFrame, drawings: DataFrame, page_keys: list[str], table_id: str, t: Box, d: Box) -> DataFrame:
    """Border of each table: the most frequent colour (first drawn on ties) and the median thickness of
    the candidates that touch it within two points. drawings: ordinal, border (a candidate)."""
    hits = tables.join(drawings.where("border is not null"), page_keys).where(touches(t.padded(2), d))
    colors = hits.groupBy(*page_keys, table_id, F.col("border.color").alias("c")).agg(F.count("*").alias("n"), F.min("ordinal").alias("o"))
    colors = colors.groupBy(*page_keys, table_id).agg(F.min_by("c", F.struct(-F.col("n"), "o")).alias("c"))
    widths = hits.groupBy(*page_keys, table_id).agg(F.median("border.thickness").alias("w"))
    every = tables.select(*page_keys, table_id).join(colors, [*page_keys, table_id], "left").join(widths, [*page_keys, table_id], "left")
    return every.select(*page_keys, table_id, F.coalesce("c", F.lit(DEFAULT_BORDER)).alias("border_color"), F.least(F.greatest(F.coalesce("w", _d(DEFAULT_WIDTH)), _d(BORDER[0])), _d(BORDER[1])).alias("border_width"))


def cell_fills(cells: DataFrame, drawings: DataFrame, page_keys: list[str], cell_id: str, c: Box, d: Box) -> DataFrame:
    """Fill of each cell: that of the drawing which covers most of it, at least 0.70; white is none.
    drawings: ordinal, fill_color; bars of up to three points don't count."""
    share = intersection_area(d, c) / F.greatest(c.width * c.height, _d(1))
    hits = cells.join(drawings.where("fill_color is not null"), page_keys).where((share >= 0.7) & (F.least(d.width, d.height) > 3))
    best = hits.groupBy(*page_keys, cell_id).agg(F.min_by("fill_color", F.struct((-share).alias("s"), "ordinal")).alias("f"))
    return best.select(*page_keys, cell_id, F.nullif(F.col("f"), F.lit("#FFFFFF")).alias("fill"))


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, is_header of each table's first row, by its text, bold, fill and font against the
    rest. cells: row_index, text, bold_chars, chars, fill, font_size."""
    first = F.col("row_index") == F.min("row_index").over(Window.partitionBy(*keys))
    c = cells.withColumn("_first", first)
    part = lambda f, cond, x: f(F.when(cond, x))
    has, bold = F.trim(F.coalesce("text", F.lit(""))) != "", F.col("bold_chars") / F.greatest(F.col("chars"), F.lit(1))
    aggs = []
    for name, side in (("a", F.col("_first")), ("b", ~F.col("_first"))):
        aggs += [
            F.count_if(side).alias(f"{name}n"), (F.sum(F.when(side, F.col("bold_chars"))) / F.greatest(F.sum(F.when(side, F.col("chars"))), F.lit(1))).alias(f"{name}bold"),
            part(F.avg, side & has, (bold >= 0.6).cast("double")).alias(f"{name}cells"), part(F.avg, side, F.col("fill").isNotNull().cast("double")).alias(f"{name}fill"),
            F.median(F.when(side & (F.col("font_size") > 0), F.col("font_size"))).alias(f"{name}font"), part(F.avg, side, has.cast("double")).alias(f"{name}text")]
    t = c.groupBy(*keys).agg(*aggs)
    z = lambda n: F.coalesce(F.col(n), _d(0))
    points = lambda cond, p: F.when(cond, _d(p)).otherwise(_d(0))
    score = (
        _d(0.1) + points((z("abold") >= 0.6) & (z("acells") >= 0.75) & (z("abold") - z("bbold") >= 0.25) & (z("acells") - z("bcells") >= 0.25), 0.45) + points((z("afill") >= 0.5) & (z("afill") - z("bfill") >= 0.25), 0.45)
        + points((z("afont") > 0) & (z("bfont") > 0) & (z("afont") - z("bfont") >= 0.5), 0.15) + points(z("atext") >= 0.9, 0.1))
    ok = (F.col("an") > 0) & (F.col("bn") > 0) & (z("atext") >= 0.5)
    return t.select(*keys, F.when(ok, score).otherwise(_d(0)).alias("score"), (ok & (score >= 0.55)).alias("is_header"))


def column_widths(columns: DataFrame, keys: list[str], available: float) -> DataFrame:
    """Adds word_width: widths scaled to the table's width within 36 and what is available, each at
    least 6, and scaled once more if that makes them too wide."""
    w = Window.partitionBy(*keys)
    first = F.greatest(F.col("width"), _d(6))
    c = columns.withColumn("_s", first)
    total = F.sum("_s").over(w)
    c = c.withColumn("_w", F.greatest(F.col("_s") * (F.least(F.greatest(total, _d(36)), _d(available)) / total), _d(6)))
    again = F.sum("_w").over(w)
    return c.withColumn("word_width", F.when(again > available, F.greatest(F.col("_w") * (_d(available) / again), _d(1))).otherwise(F.col("_w"))).drop("_s", "_w")


def merged_segments(segments: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """Collinear segments (start, end, at) joined where they meet: keys, start, end, at.

    Segments join the first group at their position if they begin at its end or before. Since they
    come by position and start, that is a running maximum within runs of equal position.
    """
    w = Window.partitionBy(*keys).orderBy("at", "start", "end")
    s = segments.withColumn("_p", F.when(F.col("at") - F.lag("at").over(w) <= tolerance, 0).otherwise(1))
    s = s.withColumn("_line", F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(*keys, "_line").orderBy("start", "end")
    reach = F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_g", F.when(F.col("start") <= reach + tolerance, 0).otherwise(1))
    s = s.withColumn("_part", F.sum("_g").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_line", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("at")).drop("_line", "_part")


def without_wrappers(rows: DataFrame, keys: list[str], order: str, wrapper: Column) -> DataFrame:
    """rows without those at the head and tail that hold a single cell as wide as the table; one stays."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_x", wrapper)
    inner = F.when(~F.col("_x"), F.col(order))
    r = r.withColumns({"_lo": F.min(inner).over(w), "_hi": F.max(inner).over(w), "_last": F.max(order).over(w)})
    # if all are wrappers, popping from the head leaves the last one
    return r.where((F.col("_lo").isNull() & (F.col(order) == F.col("_last"))) | F.col(order).between(F.col("_lo"), F.col("_hi"))).drop("_x", "_lo", "_hi", "_last")


def estimated_columns(items: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys, column_count: 2 where the largest gap between centres splits a page's items in two halves
    beside each other, else 1. items: text and a box."""
    b = Box.of()
    fit = items.where((F.char_length("text") >= 20) & (b.width <= width * 0.72)).withColumn("_c", b.center_x)
    w = Window.partitionBy(*keys).orderBy("_c", "top", "left")
    fit = fit.withColumns({"_k": F.row_number().over(w), "_gap": F.lead("_c").over(w) - F.col("_c"), "_n": F.count("*").over(Window.partitionBy(*keys))})
    cut = fit.groupBy(*keys).agg(F.max("_gap").alias("_g"), F.min_by("_k", F.struct((-F.coalesce("_gap", _d(-1))).alias("g"), "_k")).alias("_cut"), F.first("_n").alias("_size"))
    parts = fit.join(cut.drop("_size"), keys)
    left = F.col("_k") <= F.col("_cut")
    on = lambda f, cond, c: f(F.when(cond, F.col(c)))
    g = parts.groupBy(*keys).agg(
        F.max("_g").alias("gap"), F.max("_n").alias("n"), F.count_if(left).alias("ln"), F.count_if(~left).alias("rn"), on(F.median, left, "right").alias("lr"), on(F.median, ~left, "left").alias("rl"),
        on(F.min, left, "top").alias("lt"), on(F.max, left, "bottom").alias("lb"), on(F.min, ~left, "top").alias("rt"), on(F.max, ~left, "bottom").alias("rb"))
    shared = F.greatest(F.least("lb", "rb") - F.greatest("lt", "rt"), _d(0)) / F.greatest(F.least(F.col("lb") - F.col("lt"), F.col("rb") - F.col("rt")), _d(1))
    two = (F.col("n") >= 4) & (F.col("gap") >= width * 0.14) & (F.col("ln") >= 2) & (F.col("rn") >= 2) & (F.col("lr") < F.col("rl")) & (shared >= 0.2)
    found = g.select(*keys, F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("column_count"))
    return items.select(*keys).distinct().join(found, keys, "left").na.fill(1, ["column_count"])
