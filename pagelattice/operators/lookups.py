"""Identifiers, numbers that give way, lookups by source and number, and the outcome of merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.numbers import word_font_size
from pagelattice.functions.text import font_family, strip
from pagelattice.operators.grouped import map_groups
from pagelattice.operators.tables import _grid_counts

#: Share of merges in conflict beyond which a table is a picture; how much of the confidence the merges make.
CONFLICTS, MERGED = 0.25, 0.2


def first_integer(*values: Column) -> Column:
    """The first value that reads as a whole number, as a long."""
    return F.coalesce(*(v.cast("string").try_cast("bigint") for v in values))


def first_category(*values: Column) -> Column:
    """The first value that isn't null, stripped and in lower case; '' if none is."""
    return F.coalesce(F.lower(strip(F.coalesce(*(v.cast("string") for v in values)))), F.lit(""))


def item_id(kind: Column, identifier: Column, index: Column) -> Column:
    """kind:identifier, or the place from 1 where there is none."""
    return F.concat(kind, F.lit(":"), F.coalesce(identifier.cast("string"), (index + 1).cast("string")))


def table_id(page: Column, index: Column, *names: Column) -> Column:
    """table:page:name with the first name that isn't blank, or the place from 1."""
    named = F.coalesce(*(F.nullif(strip(n.cast("string")), F.lit("")) for n in names))
    return F.concat(F.lit("table:"), page.cast("string"), F.lit(":"), F.coalesce(named, (index + 1).cast("string")))


def numbered(items: DataFrame, keys: list[str], order: list[str], number: str, name: str = "item_number") -> DataFrame:
    """items with their number, or their place from 1 where it is null; one that is taken gives way to the next free
    number. Order decides, so that a page's items go one by one."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), f"`{name}` bigint"])

    def run(rows):
        used: set[int] = set()
        after: dict[int, int] = {}  # where the search from a taken number last ended
        for place, r in enumerate(rows, 1):
            first = n = place if r[number] is None else r[number]
            while n in used:
                n = after.get(n, n + 1)
            used.add(n)
            after[first] = n + 1
            yield {**r, name: n}

    return map_groups(items, keys, order, run, schema)


def with_layout(items: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """items (source_id, region_number) with layout_id: of the layout row with the same source, else of the last one by
    layout_id with the same region number; null where there is neither. layout: layout_id, source_id, region_number."""
    last = lambda by, name: layout.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.max("layout_id").alias(name))
    i = items.join(last("source_id", "_own"), [*keys, "source_id"], "left").join(last("region_number", "_at"), [*keys, "region_number"], "left")
    return i.select(*items.columns, F.coalesce("_own", "_at").alias("layout_id"))


def marker_styles(spans: DataFrame, keys: list[str], marker: str = "marker") -> DataFrame:
    """keys, font, font_size of the marker of each list item: that of the first span with text that isn't the marker itself,
    by line and left edge. Where only the marker has text it is Arial in the size of the last span; without any, 11 points."""
    text = strip(F.coalesce("text", F.lit("")))
    own = (F.coalesce(strip(marker), F.lit("")) != "") & (text == strip(marker))
    at = F.struct("line_index", "left", "span_index")
    style = F.struct("font", "font_size")  # named and rounded once a list item, not once a span
    s = spans.withColumns({"_seen": text != "", "_own": F.coalesce(own, F.lit(False)), "_at": at, "_style": style})
    g = s.groupBy(*keys).agg(
        F.min_by("_style", F.when(F.col("_seen") & ~F.col("_own"), F.col("_at"))).alias("first"), F.count_if(F.col("_seen") & ~F.col("_own")).alias("n"), F.max_by("_style", F.when(F.col("_seen"), F.col("_at"))).alias("last"), F.count_if("_seen").alias("seen"))
    return g.select(*keys, F.when(F.col("n") > 0, font_family(F.col("first.font"))).otherwise("Arial").alias("font"), F.when(F.col("n") > 0, word_font_size(F.col("first.font_size"))).when(F.col("seen") > 0, word_font_size(F.col("last.font_size"))).otherwise(11.0).alias("font_size"))


def merge_attempts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every merge that cells ask for, in their order, and what came of it: keys, row_index, column_index, row_span, column_span,
    confidence, outcome (accepted, conflict with a position that isn't free, or weak). cells as in tables.merges()."""
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", row_index int, column_index int, row_span int, column_span int, confidence double, outcome string"

    def run(rows):
        free = {(r["row_index"], r["column_index"]) for r in rows if r["synthetic"] and not r["has_content"]}
        for r in rows:
            h, w = r["want_rows"], r["want_cols"]
            if r["synthetic"] or not r["has_content"] or (h == 1 and w == 1):
                continue
            at = r["row_index"], r["column_index"]
            new = {(at[0] + i, at[1] + j) for i in range(h) for j in range(w)} - {at}
            confidence = min(max(0.75 * r["geometry"] + 0.15 * r["borderless"] + 0.1, 0.0), 1.0)
            outcome = "conflict" if not new <= free else "accepted" if confidence >= 0.72 else "weak"
            if outcome == "accepted":
                free -= new
            yield {**{k: r[k] for k in keys}, "row_index": at[0], "column_index": at[1], "row_span": h, "column_span": w, "confidence": confidence, "outcome": outcome}

    return map_groups(cells, keys, ["row_index", "column_index"], run, schema)


def merge_outcome(tables: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """tables (confidence, disposition, structure_errors) with evaluated, conflicts and what merging leaves of confidence and disposition.

    A table with structural errors, or of whose merges over a quarter are in conflict, is a picture and keeps its confidence; else
    the mean confidence of the accepted merges makes a fifth of it.
    """
    g = attempts.groupBy(*keys).agg(F.count("*").alias("evaluated"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.avg(F.when(F.col("outcome") == "accepted", F.col("confidence"))).alias("_mean"))
    t = tables.join(g, keys, "left").na.fill(0, ["evaluated", "conflicts"])
    bad = (F.col("structure_errors") > 0) | (F.col("conflicts") / F.greatest(F.col("evaluated"), F.lit(1)) > CONFLICTS)
    mixed = F.least(F.greatest(F.col("confidence") * (1 - MERGED) + F.col("_mean") * MERGED, F.lit(0.0)), F.lit(1.0))
    return t.withColumns({"confidence": F.when(bad | F.col("_mean").isNull(), F.col("confidence")).otherwise(mixed), "disposition": F.when(bad, "visual_fallback").otherwise(F.col("disposition"))}).drop("_mean")


def renderable(tables: DataFrame, cells: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, renderable, reason: whether a table can be written natively. It must be editable, have no uncovered position and a
    definition of each row and column; reason names the first thing that is amiss, null if nothing is."""
    place = F.struct(*(F.col(c).cast("int").alias(n) for c, n in (("row_index", "r"), ("column_index", "c"), ("row_span", "h"), ("column_span", "w"))))
    t = tables.join(cells.groupBy(*keys).agg(F.collect_list(place).alias("_cells")), keys, "left")
    for df, name in ((rows, "_rows"), (columns, "_columns")):
        t = t.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")
    t = _grid_counts(t.na.fill(0, ["_rows", "_columns"]), "_cells")
    reason = (
        F.when(F.coalesce(F.col("disposition") != "editable", F.lit(True)), "not_editable").when(F.col("gaps") > 0, "uncovered_positions")
        .when(F.col("_rows") != F.col("row_count"), "incomplete_rows").when(F.col("_columns") != F.col("column_count"), "incomplete_columns"))
    return t.select(*keys, reason.isNull().alias("renderable"), reason.alias("reason"))
