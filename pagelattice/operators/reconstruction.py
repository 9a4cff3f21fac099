"""Repair of table grids: cells snapped to boundaries, blank cells for gaps, and what that does to confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.tables import SNAP, UNIFORM, axis_boundaries, missing, owned, with_cells

#: Confidence of a blank cell made to fill a gap; bounds of an editable table.
BLANK, MOST_BLANK, LEAST_CONFIDENCE = 0.45, 0.35, 0.55
SIDES = ("left", "top", "right", "bottom")


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


_AXES = {"row": ("row_index", "row_span", "top", "bottom", "row_count", ("top", "bottom")), "column": ("column_index", "column_span", "left", "right", "column_count", ("left", "right"))}


def edges(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table: keys, row_edges and column_edges (sorted positions) and grid_confidence, the mean of
    all boundaries' confidences. A table has at most some thousands of them, and meets its cells once, as one row with an array."""
    t = tables.select(*keys, "row_count", "column_count", *SIDES)
    t = with_cells(t.where("row_count is not null or column_count is not null"), cells, keys, ["row_index", "column_index", "row_span", "column_span", *SIDES])
    for name, of in _AXES.items():
        t = axis_boundaries(t, f"_{name}", "_cells", *of)
    none = F.array().cast("array<double>")
    of = lambda name, what: F.coalesce(F.transform(name, lambda s: s[what]), none)
    t = t.select(*keys, of("_row", "position").alias("row_edges"), of("_column", "position").alias("column_edges"), F.concat(of("_row", "confidence"), of("_column", "confidence")).alias("_c"))
    total = F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + x)
    return t.select(*keys, "row_edges", "column_edges", (total / F.size("_c")).alias("grid_confidence"))


def _expected(row, column, row_span, column_span) -> list[Column]:
    """The box between the boundaries, null where one of them isn't on the grid."""
    at = lambda array, k: F.when(k >= 0, F.try_element_at(F.col(array), (k + 1).cast("int")))
    return [at("column_edges", column), at("row_edges", row), at("column_edges", column + column_span), at("row_edges", row + row_span)]


def snapped(cells: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """cells (indices, spans, box, confidence) with their boxes on the boundaries of edges(), moved (the most that a side
    moved), far (more than 4 points) and confidence 0.7 of the cell's and 0.3 of the grid's.

    A cell that reaches out of the grid keeps its box and confidence, and moved is null.
    """
    c = cells.join(grid, keys)
    to = _expected(*(F.col(x) for x in ("row_index", "column_index", "row_span", "column_span")))
    inside = F.lit(True)
    for x in to:
        inside = inside & x.isNotNull()
    c = c.withColumns({"_in": inside, **{f"_{s}": x for s, x in zip(SIDES, to, strict=True)}})
    moved = F.when(F.col("_in"), F.greatest(*(F.abs(F.col(s) - F.col(f"_{s}")) for s in SIDES)))
    c = c.withColumn("moved", moved).withColumn("far", F.coalesce(F.col("moved") > SNAP, F.lit(False)))
    c = c.withColumns({s: F.when(F.col("_in"), F.col(f"_{s}")).otherwise(F.col(s)) for s in SIDES})
    blend = _clamp(F.col("confidence") * 0.7 + F.col("grid_confidence") * 0.3)
    c = c.withColumn("confidence", F.when(F.col("_in"), blend).otherwise(F.col("confidence")))
    return c.drop("_in", *(f"_{s}" for s in SIDES), "row_edges", "column_edges", "grid_confidence")


def blanks(tables: DataFrame, cells: DataFrame, grid: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A blank cell for each grid position that no cell covers, in the columns of cells: synthetic, without text, of
    confidence 0.45, with the borders and padding of the table's first cell by order, where cells have them."""
    gaps = missing(tables, cells, keys).join(grid, keys)
    spare = [c for c in ("borders", "padding") if c in cells.columns]
    if spare:
        first = cells.groupBy(*keys).agg(F.min_by(F.struct(*spare), F.struct(*order)).alias("_like"))
        gaps = gaps.join(first, keys, "left")
    box = dict(zip(SIDES, _expected(F.col("row"), F.col("col"), F.lit(1), F.lit(1)), strict=True))
    made = {"row_index": F.col("row"), "column_index": F.col("col"), "row_span": F.lit(1), "column_span": F.lit(1), **box, "confidence": F.lit(BLANK), "synthetic": F.lit(True), "has_content": F.lit(False), "text": F.lit("")}
    made |= {c: F.col(f"_like.{c}") for c in spare}
    of = {f.name: f.dataType for f in cells.schema.fields}
    return gaps.select(*keys, *(made.get(c, F.lit(None)).cast(t).alias(c) for c, t in of.items() if c not in keys))


def reconstructed(tables: DataFrame, cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """cells on the grid, with blank cells for its gaps, and moved and far; see snapped() and blanks()."""
    grid = edges(tables, cells, keys)
    on = snapped(cells, grid, keys)
    inside = cells.join(tables.select(*keys, "row_count", "column_count"), keys)
    inside = inside.where("row_index >= 0 and column_index >= 0 and row_span >= 1 and column_span >= 1 and row_index + row_span <= row_count and column_index + column_span <= column_count").select(*cells.columns)
    made = blanks(tables, inside, grid, keys, order)
    return on.unionByName(made.withColumns({"moved": F.lit(None).cast("double"), "far": F.lit(False)}))


def finalized(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each table after its repair: keys, synthetic_cells, confidence, structure_errors, disposition.

    tables: confidence; cells: the source's, before the repair. Confidence mixes the table's, the grid's and the share of positions that weren't
    made up. A table stays editable if its structure holds, at most 0.35 of it is made up and confidence is 0.55
    or more; one without cells is a picture, of confidence 0.4 at most.
    """
    grid = edges(tables, cells, keys)
    t = owned(tables, cells, keys)
    gaps = F.aggregate("_gaps", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"] + 1)
    t = t.withColumns({"_gaps": gaps, "_errors": (F.size("_twice") + F.size("_out") + F.size("_over")).cast("long")}).drop("_twice", "_out", "_over")
    old = cells.groupBy(*keys).agg(F.count("*").alias("_cells"), F.count_if("synthetic").alias("_old"))
    t = t.join(grid.select(*keys, "grid_confidence"), keys, "left").join(old, keys, "left").na.fill(0, ["_cells", "_old"])
    none = F.col("_cells") == 0
    synthetic = F.when(none, F.lit(0).cast("long")).otherwise(F.col("_old") + F.col("_gaps"))
    share = F.least(synthetic / F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1)), F.lit(1.0))
    mixed = _clamp(F.col("confidence") * 0.45 + F.col("grid_confidence") * 0.35 + (F.lit(1.0) - share) * 0.2)
    confidence = F.when(none, F.least(F.col("confidence"), F.lit(UNIFORM))).otherwise(mixed)
    bad = none | (F.col("_errors") > 0) | (share > MOST_BLANK) | (confidence < LEAST_CONFIDENCE)
    return t.select(*keys, synthetic.alias("synthetic_cells"), confidence.alias("confidence"), F.col("_errors").alias("structure_errors"), F.when(bad, "visual_fallback").otherwise("editable").alias("disposition"))


def matched(items: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """items of a plan with table_id, the editable table that each stands for, and how it was found.

    items: item_id, source_id, source_index; tables: table_id, source_id and table_index, its place on the page from 0.
    An item's table is the first by table_index with its source ("identity"). Without one it is the table at
    its source_index, if that one has no source or the item's own ("index"). Items left have a null table_id.
    """
    first = tables.where("source_id is not null").groupBy(*keys, "source_id").agg(F.min_by("table_id", "table_index").alias("_own"))
    place = tables.select(*keys, F.col("table_index").alias("source_index"), F.col("table_id").alias("_at"), F.col("source_id").isNull().alias("_free"))
    i = items.join(first, [*keys, "source_id"], "left").join(place, [*keys, "source_index"], "left")
    # a table at the index with the item's own source would have been found by it
    at = F.when(F.col("_free"), F.col("_at"))
    return i.select(*items.columns, F.coalesce("_own", at).alias("table_id"), F.when(F.col("_own").isNotNull(), "identity").when(at.isNotNull(), "index").alias("matched_by"))


def instructions(items: DataFrame, layout: DataFrame, policies: DataFrame, keys: list[str]) -> DataFrame:
    """What the writer does on each page, and from which plan: keys, provenance, item_id, instruction_order, reason.

    Pages whose policy asks for a picture have a page_fallback at order 0 before the items of their plan, pages with items
    these ("plan"), and pages without any the paragraphs of layout in their order ("legacy"), but those that are
    a list marker alone. policies: use_page_fallback, mode; items: item_id, render_order; layout: item_id, plan_order, marker_only.
    The stages share one scan of each input; pages with a plan are told apart by an anti join.
    """
    wants = F.coalesce("use_page_fallback", F.lit(False)) | F.coalesce(F.lower("mode").isin("image_fallback", "page_fallback"), F.lit(False))
    whole = policies.where(wants).select(*keys, F.lit("page_fallback").alias("provenance"), F.concat_ws(":", F.lit("page_fallback"), *[F.col(k).cast("string") for k in keys]).alias("item_id"), F.lit(0).alias("instruction_order"), F.lit("policy").alias("reason"))
    plan = items.select(*keys, F.lit("plan").alias("provenance"), F.col("item_id").cast("string").alias("item_id"), F.col("render_order").cast("int").alias("instruction_order"), F.lit("item").alias("reason"))
    planned = plan.select(*keys).unionByName(whole.select(*keys)).distinct()
    shown = layout.where(~F.coalesce("marker_only", F.lit(False)))
    old = shown.join(planned, keys, "left_anti").select(*keys, F.lit("legacy").alias("provenance"), F.col("item_id").cast("string").alias("item_id"), F.col("plan_order").cast("int").alias("instruction_order"), F.lit("no_plan").alias("reason"))
    return whole.unionByName(plan).unionByName(old)
