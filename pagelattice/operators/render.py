"""Render plan: strategy, suppression, anchors and order of a page's items; actions of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, intersection_area

# Default confidence by kind, and ranks of placements and roles.
CONFIDENCE = {"paragraph": 0.9, "table": 0.75, "image": 0.95, "chart": 0.7, "vector": 0.7, "page_fallback": 1.0}
PLACEMENTS = {"background": 0, "flow": 1, "floating": 2, "overlay": 3}
ROLES = {"header": 0, "body": 1, "body_spanning": 2, "column": 3, "unassigned": 4, "decoration": 5, "footer": 6}
ROLE_NAMES = {"header": "header", "body": "body", "body_spanning": "body_spanning", "spanning": "body_spanning", "column": "column", "footer": "footer", "decoration": "decoration", "decorative": "decoration", "unassigned": "unassigned"}
BODY = ("body", "body_spanning", "column", "unassigned")
COVERED, TABLE_CONFIDENCE = 0.85, 0.65


def _map(values: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(other))


def role_name(c: Column) -> Column:
    """Role of a layout name, null for names without one (page_body among them)."""
    return F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])[F.lower(F.trim(c))]


def strategy(kind: Column, category: Column, role: Column, confidence: Column, reliable: Column, page_share: Column) -> tuple[Column, Column]:
    """Placement and disposition of an item."""
    back = category.isin("background", "watermark", "page_background")
    band = role.isin("header", "footer")
    visual, vector = kind.isin("image", "chart"), kind == "vector"
    placement = (
        F.when(kind == "table", F.when(band, "floating").otherwise("flow")).when(visual & back, "background").when(visual, F.when(band, "floating").otherwise("flow"))
        .when(vector & back, "background").when(vector & category.isin("decorative", "decoration"), F.when(page_share >= 0.2, "background").otherwise("overlay")).when(vector, "overlay")
        .when(kind == "page_fallback", "background").otherwise(F.when(band, "floating").otherwise("flow")))
    weak = F.coalesce(~reliable, F.lit(False)) | (confidence < TABLE_CONFIDENCE)
    disposition = F.when(kind == "table", F.when(weak, "visual").otherwise("editable")).when(visual, "visual").when(vector & category.isin("bullet", "noise"), "skip").when(vector, "visual").when(kind == "page_fallback", "fallback").otherwise("editable")
    return placement, disposition


def suppress(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """items whose paragraphs are at least 0.85 inside a table, image or chart become skip, with covered_by.

    Headers and footers are exempt. covered_by is the first such item by id. Each item meets its page's covers as
    an array, so that items dealt by page aren't shuffled again.
    """
    known = F.lit(True)
    for k in (*keys, id_col):
        known = known & F.col(k).isNotNull()
    whole = known & (F.col("disposition") != "skip")
    cover = F.when(whole & F.col("kind").isin("table", "image", "chart"), F.struct(F.col(id_col).alias("_c"), *Box._fields))
    p = Box.of()
    size = p.width * p.height
    inside = lambda c: F.coalesce((size > 0) & (intersection_area(p, Box(*(c[n] for n in Box._fields))) / F.nullif(size, F.lit(0.0)) >= COVERED), F.lit(False))
    text = whole & (F.col("kind") == "paragraph") & ~F.col("role").isin("header", "footer")
    d = items.withColumn("_covers", F.collect_list(cover).over(Window.partitionBy(*keys)))
    d = d.withColumn("_by", F.when(text, F.array_min(F.transform(F.filter("_covers", inside), lambda c: c["_c"])))).drop("_covers")
    # of rows with one id all go with one that is covered
    d = d.withColumn("covered_by", F.when(known, F.min("_by").over(Window.partitionBy(*keys, id_col)))).drop("_by")
    return d.withColumn("disposition", F.when(F.col("covered_by").isNotNull(), "skip").otherwise(F.col("disposition")))


def compatible(a: str, b: str) -> Column:
    """Whether items of prefixes a and b may share an order: bands match, then columns, then regions."""
    r, s = F.col(f"{a}role"), F.col(f"{b}role")
    x, y, u, v = F.col(f"{a}column_id"), F.col(f"{b}column_id"), F.col(f"{a}region_id"), F.col(f"{b}region_id")
    bands = r.isin("header", "footer") | s.isin("header", "footer")
    return F.when(bands, r == s).when(x.isNotNull() & y.isNotNull(), x == y).when(u.isNotNull() & v.isNotNull(), u == v).otherwise(r.isin(*BODY) & s.isin(*BODY))


def anchors(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds anchor: an item's reading order, or for others a place between the compatible paragraphs
    above and below it (a nearest-neighbour join both ways on the centre).

    Without compatible ones all paragraphs count; without any, 100000 plus the top.
    """
    cy = (F.col("top") + F.col("bottom")) / 2
    p = items.where((F.col("kind") == "paragraph") & F.col("reading_order").isNotNull()).select(*keys, cy.alias("p_cy"), F.col("reading_order").cast("double").alias("p_order"), *(F.col(c).alias(f"p_{c}") for c in ("role", "column_id", "region_id")))
    o = items.where(F.col("reading_order").isNull()).select(*keys, F.col(id_col).alias("_o"), cy.alias("o_cy"), *(F.col(c).alias(f"o_{c}") for c in ("role", "column_id", "region_id")))
    pairs = o.join(p, keys).withColumn("fits", F.coalesce(compatible("o_", "p_"), F.lit(False)))
    at, above = F.struct("p_cy", "p_order"), F.col("p_cy") <= F.col("o_cy")
    pick = lambda f, cond, name: f(F.when(cond, at)).alias(name)
    best = pairs.groupBy(*keys, "_o").agg(
        F.bool_or("fits").alias("any"), pick(F.max, F.col("fits") & above, "fa"), pick(F.min, F.col("fits") & ~above, "fb"), pick(F.max, above, "aa"), pick(F.min, ~above, "ab"))
    before, after = (F.when(F.col("any"), F.col(f"f{s}.p_order")).otherwise(F.col(f"a{s}.p_order")) for s in "ab")
    between = F.when(before.isNotNull() & after.isNotNull(), before + (after - before) / 2).otherwise(F.coalesce(before + 0.5, after - 0.5))
    found = best.select(*keys, F.col("_o").alias(id_col), between.alias("_between"))
    joined = items.join(found, [*keys, id_col], "left")
    return joined.withColumn("anchor", F.coalesce(F.col("reading_order").cast("double"), "_between", F.lit(100000.0) + F.col("top"))).drop("_between")


def ordered(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds render_order over a page: placement, then anchor and role in the flow, role and anchor outside it."""
    flow, back = F.col("placement") == "flow", F.col("placement") == "background"
    anchor = F.when(back, F.lit(-1e6)).otherwise(F.col("anchor"))
    role = _map(ROLES, F.col("role"), 99).cast("double")
    first, second = F.when(flow, anchor).otherwise(role), F.when(flow, role).otherwise(anchor)
    w = Window.partitionBy(*keys).orderBy(_map(PLACEMENTS, F.col("placement"), 99), first, second, "top", "left", id_col)
    return items.withColumn("render_order", F.row_number().over(w))


def containing_region(items: DataFrame, regions: DataFrame, keys: list[str], id_col: str, b: Box, r: Box) -> DataFrame:
    """The smallest region of the page that covers at least 0.75 of each item: keys, id, region_id."""
    inside = intersection_area(b, r) / F.greatest(b.width * b.height, F.lit(1.0)) >= 0.75
    size = F.greatest(r.width * r.height, F.lit(1.0))
    best = F.min(F.when(inside, F.struct(size.alias("s"), F.col("region_id"))))
    return items.join(regions, keys).groupBy(*keys, id_col).agg(best.alias("b")).select(*keys, id_col, F.col("b.region_id").alias("region_id"))


def action(kind: Column, role: Column, placement: Column, disposition: Column, decision: Column, has_layout: Column) -> Column:
    """What the writer does with an item of the plan."""
    table = (
        F.when((disposition == "skip") | role.isin("header", "footer") | (placement != "flow"), "ignore")
        .when((disposition == "editable") & decision.isin("native_safe", "native_with_warnings"), "render_table").otherwise("defer_table"))
    text = F.when((disposition == "skip") | role.isin("header", "footer") | (placement != "flow") | ~has_layout, "ignore").otherwise("render_paragraph")
    other = F.when(disposition == "skip", "ignore").otherwise(F.concat(F.lit("defer_"), kind))
    return F.when(kind == "table", table).when(kind == "paragraph", text).otherwise(other)

#: Issues that keep a detected alignment out of the file.
BLOCKING = (
    "missing_result", "duplicate_result", "reference_mismatch", "paragraph_outside_reference", "center_geometry_conflict", "right_geometry_conflict", "left_geometry_conflict", "justify_geometry_conflict")


def layout_plan(paragraphs: DataFrame, order: DataFrame, alignments: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Paragraphs in their order with role and the alignment that is safe to write.

    order: role, reading_order. alignments: alignment, confidence, issue_codes. Paragraphs without an
    order follow as unassigned, by top and left. An unknown or weak alignment, or one with a blocking
    issue, isn't applied.
    """
    p = paragraphs.join(order, [*keys, id_col], "left").join(alignments, [*keys, id_col], "left")
    blocked = F.arrays_overlap(F.coalesce("issue_codes", F.array().cast("array<string>")), F.array(*map(F.lit, BLOCKING)))
    safe = F.col("alignment").isNotNull() & (F.col("alignment") != "unknown") & (F.col("confidence") >= 0.55) & ~blocked
    w = Window.partitionBy(*keys).orderBy(F.col("reading_order").asc_nulls_last(), "top", "left", id_col)
    return p.withColumns({"role": F.coalesce("role", F.lit("unassigned")), "word_alignment": F.when(F.coalesce(safe, F.lit(False)), F.col("alignment")), "plan_order": F.row_number().over(w)})
