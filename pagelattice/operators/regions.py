"""Layout regions: members, the columns that they stand for, their reading order, and lines within cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points that a span's baseline may be off the first one of its line, in a table cell.
BASELINE = 2.0


def members(items: DataFrame, keys: list[str], region: str, order: list[str], item: str = "paragraph", blocks: str = "source_block_numbers") -> DataFrame:
    """One row per region: keys, region, members (its items in order, each once) and blocks (the source
    blocks of them all, each once, in the order of the items). Items without a region are in none."""
    of = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"), F.coalesce(blocks, F.array().cast("array<int>")).alias("_blocks"))))
    g = items.where(F.col(region).isNotNull()).groupBy(*keys, region).agg(of.alias("_of"))
    return g.select(*keys, region, F.array_distinct(F.transform("_of", lambda s: s["_item"])).alias("members"), F.array_distinct(F.flatten(F.transform("_of", lambda s: s["_blocks"]))).alias("blocks"))


def nodes(regions: DataFrame, items: DataFrame, keys: list[str], region: str, item: str = "paragraph") -> DataFrame:
    """keys, region, place (from 0 in the order of members) and the columns of items, for members that are items."""
    each = regions.select(*keys, region, F.posexplode("members").alias("place", item))
    return each.join(items, [*keys, item])


def column_regions(columns: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """columns (column_id, left, top) with region_id: the first column by left edge and top stands for the first region
    of type column, the second for the second. Columns beyond the regions have a null region_id, and regions
    beyond the columns are left over."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("left", "top"))
    theirs = regions.where("region_type = 'column'").select(*keys, rank.alias("_rank"), "region_id")
    return columns.withColumn("_rank", rank).join(theirs, [*keys, "_rank"], "left").drop("_rank")


def region_orders(regions: DataFrame, entries: DataFrame, keys: list[str], region: str, item: str = "paragraph") -> DataFrame:
    """keys, region, reading_order: the least order of a region's members, null where none is in the reading order.
    entries: item, reading_order."""
    each = regions.select(*keys, region, F.explode_outer("members").alias(item)).join(entries.select(*keys, item, "reading_order"), [*keys, item], "left")
    return each.groupBy(*keys, region).agg(F.min("reading_order").alias("reading_order"))


def baseline_lines(spans: DataFrame, keys: list[str], origin: str = "origin_y") -> DataFrame:
    """spans with line (from 0 within keys, a cell) and place (from 0 within the line, by left edge).

    By baseline and left edge, a span begins a line if its baseline is more than two points off that of the span
    that began the last one. A cell's spans are one array while the lines are cut, not a copy for each row.
    """
    rest = [c for c in spans.columns if c not in keys]
    row = F.struct(F.col(origin).alias("_y"), F.col("left").alias("_x"), F.struct(*rest).alias("_s"))
    cell = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("out"))

    def step(acc, s):
        new = acc["first"].isNull() | (F.abs(s["_y"] - acc["first"]) > BASELINE)
        line = acc["line"] + F.when(new, 1).otherwise(0)
        return F.struct(line.alias("line"), F.when(new, s["_y"]).otherwise(acc["first"]).alias("first"), F.concat(acc["out"], F.array(line)).alias("out"))

    cut = cell.withColumn("_lines", F.aggregate("_all", start, step)["out"])
    each = cut.select(*keys, F.explode(F.arrays_zip("_all", "_lines")).alias("_z")).select(*keys, "_z._all._s.*", F.col("_z._lines").alias("line"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "line").orderBy("left", *rest)) - 1)
