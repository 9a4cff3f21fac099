"""Repeated header and footer bands, page bodies, columns and reading order."""

from __future__ import annotations

from statistics import mean, median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.text import signature
from pagelattice.operators.grouped import map_groups
from pagelattice.operators.unicode import nfkc

BAND_RATIO, BAND_HEIGHT, BAND_TEXT = 0.14, (48.0, 110.0), 180
REPEATED, SPREAD, BUCKET = 0.5, 0.035, 0.08


def band(center_y: Column, height: float) -> Column:
    """header or footer for a centre within the band at the top or bottom of a page, else null."""
    size = min(max(height * BAND_RATIO, BAND_HEIGHT[0]), BAND_HEIGHT[1])
    return F.when(center_y <= size, "header").when(center_y >= height - size, "footer")


def repeated_bands(paragraphs: DataFrame, doc_key: str, page_key: str, id_col: str, width: float, height: float) -> DataFrame:
    """Paragraphs that repeat in the same band on at least half of a document's pages (two or more).

    doc, page, id, band, confidence. Grouped by signature and horizontal bucket; positions may
    differ by 0.035 of the height. A paragraph keeps its best confidence.
    """
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    p = paragraphs.withColumns({"band": band(cy, height), "bucket": F.rint(cx / F.lit(max(width, 1.0)) / BUCKET).cast("int"), "y": cy / F.lit(max(height, 1.0))})
    pages = paragraphs.groupBy(doc_key).agg(F.count_distinct(page_key).alias("pages"))
    # only the short texts of the bands go through Python, for their normal form
    c = p.where(F.col("band").isNotNull() & (F.char_length("text") <= BAND_TEXT)).withColumn("signature", signature(nfkc(F.col("text")))).where("signature <> ''")
    groups = c.groupBy(doc_key, "band", "signature", "bucket").agg(F.count_distinct(page_key).alias("on_pages"), (F.max("y") - F.min("y")).alias("spread")).join(pages, doc_key)
    groups = groups.where((F.col("pages") >= 2) & (F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * REPEATED))) & (F.col("spread") <= SPREAD))
    score = F.lit(0.55) + F.col("on_pages") / F.col("pages") * 0.3 + F.greatest(F.lit(0.0), F.lit(1.0) - F.col("spread") / SPREAD) * 0.15
    found = c.join(groups.select(doc_key, "band", "signature", "bucket", F.least(score, F.lit(1.0)).alias("confidence")), [doc_key, "band", "signature", "bucket"])
    return found.groupBy(doc_key, page_key, id_col, "band").agg(F.max("confidence").alias("confidence"))


def body_box(items: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Box of a page's body: its items' envelope, padded, between header and footer.

    items: band (null for the body) and a box.
    """
    pad = max(4.0, width * 0.01)
    inner = lambda f, c: f(F.when(F.col("band").isNull(), F.col(c)))
    edge = lambda f, kind, c: f(F.when(F.col("band") == kind, F.col(c)))
    g = items.groupBy(*keys).agg(
        *(inner(f, c).alias(c) for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))), edge(F.max, "header", "bottom").alias("h"), edge(F.min, "footer", "top").alias("f"))
    low = F.coalesce(F.least(F.greatest(F.col("h") + 3.0, F.lit(0.0)), F.lit(height)), F.lit(0.0))
    high = F.coalesce(F.greatest(F.least(F.col("f") - 3.0, F.lit(height)), F.lit(0.0)), F.lit(height))
    left, right = F.coalesce(F.greatest(F.lit(0.0), F.col("left") - pad), F.lit(0.0)), F.coalesce(F.least(F.lit(width), F.col("right") + pad), F.lit(width))
    top, bottom = F.coalesce(F.greatest(low, F.col("top") - 3.0), low), F.coalesce(F.least(high, F.col("bottom") + 3.0), high)
    wide, tall = right > left, bottom > top
    return g.select(
        *keys, F.when(wide, left).otherwise(0.0).alias("left"), F.when(tall, top).otherwise(low).alias("top"), F.when(wide, right).otherwise(width).alias("right"), F.when(tall, bottom).otherwise(high).alias("bottom"))


def _percentile(values: list[float], p: float) -> float:
    v = sorted(values)
    at = (len(v) - 1) * p
    k = int(at)
    return v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k)


def _left_clusters(items: list[dict], tolerance: float, reach: float) -> list[list[dict]]:
    """Clusters by left edge against running medians, then neighbours within reach joined."""
    clusters: list[list[dict]] = []
    middle = lambda c: median(i["left"] for i in c)
    for item in sorted(items, key=lambda i: i["left"]):
        near = [(abs(item["left"] - middle(c)), k) for k, c in enumerate(clusters)]
        near = [x for x in near if x[0] <= tolerance]
        if near:
            clusters[min(near)[1]].append(item)
        else:
            clusters.append([item])
    merged: list[list[dict]] = []
    for c in sorted((c for c in clusters if len(c) >= 2), key=middle):
        if merged and middle(c) - middle(merged[-1]) <= reach:
            merged[-1].extend(c)
        else:
            merged.append(list(c))
    return [c for c in merged if len(c) >= 2]


def _columns(items: list[dict], width: float) -> tuple[dict[int, int], float]:
    """Column of each item (None: spanning) and the confidence; a single column if none is sure."""
    single = {k: 0 for k in range(len(items))}, 0.78
    fit = [i for i in items if len(i["text"]) >= 20 and 0.1 <= (i["right"] - i["left"]) / width <= 0.78]
    tolerance = max(10.0, width * 0.045)
    clusters = _left_clusters(fit, tolerance, max(1.5 * tolerance, 0.1 * width)) if len(fit) >= 4 else []
    clusters = sorted(sorted(clusters, key=len, reverse=True)[:4], key=lambda c: median(i["left"] for i in c))
    if len(clusters) < 2:
        return single
    edges, gutters, overlaps = [], [], []
    for a, b in zip(clusters, clusters[1:], strict=False):
        right, left = _percentile([i["right"] for i in a], 0.8), _percentile([i["left"] for i in b], 0.2)
        span = [(min(i["top"] for i in c), max(i["bottom"] for i in c)) for c in (a, b)]
        shared = max(min(s[1] for s in span) - max(s[0] for s in span), 0.0) / max(min(s[1] - s[0] for s in span), 1.0)
        apart = median(i["left"] for i in b) - median(i["left"] for i in a)
        if apart < 0.18 * width or left - right < max(12.0, 0.025 * width) or shared < 0.25:
            return single
        edges.append((left + right) / 2)
        gutters.append(min((left - right) / max(0.1 * width, 1.0), 1.0))
        overlaps.append(min(shared, 1.0))
    place = {}
    for k, i in enumerate(items):
        across = any(i["left"] + 2 < e < i["right"] - 2 for e in edges) or i["right"] - i["left"] >= 0.82 * width
        place[k] = None if across else sum((i["left"] + i["right"]) / 2 > e for e in edges)
    sizes = [list(place.values()).count(c) for c in range(len(clusters))]
    if min(sizes) < 2:
        return single
    return place, min(0.4 + 0.25 * mean(gutters) + 0.25 * mean(overlaps) + 0.1 * min(sizes) / max(sizes), 1.0)


def columns(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys, id, column_index (null: spans columns), column_count, confidence of a page's body items.

    Clusters depend on running medians, so this is one pass per page over its items.
    """
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{id_col}` {types[id_col]}, column_index int, column_count int, confidence double"

    def detect(rows):
        width = max(max(r["right"] for r in rows) - min(r["left"] for r in rows), 1.0)
        place, confidence = _columns(rows, width)
        count = max((c for c in place.values() if c is not None), default=0) + 1
        for k, r in enumerate(rows):
            yield {**{x: r[x] for x in keys}, id_col: r[id_col], "column_index": place[k], "column_count": count, "confidence": confidence}

    return map_groups(items.select(*keys, id_col, "text", "left", "top", "right", "bottom"), keys, ["top", "left", id_col], detect, schema)


def reading_order(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds role and reading_order (1, 2, ..): header, body, unassigned, footer.

    items: band, column_index (null spans), column_count, in_body, rtl and a box. In a body of columns
    each spanning item, from top to bottom, comes after the column items whose centre lies at least
    two points above its own, column by column; the rest of the columns follow. As a sort key: an
    item's segment is the first spanning item that lies below it.
    """
    page = Window.partitionBy(*keys)
    cy = (F.col("top") + F.col("bottom")) / 2
    many = (F.col("column_count") >= 2) & F.col("in_body") & F.col("band").isNull()
    spans = many & F.col("column_index").isNull()
    x = F.when(F.col("rtl"), -F.col("left")).otherwise(F.col("left"))
    rows = items.withColumns({"_cy": cy, "_x": x, "_spans": F.coalesce(spans, F.lit(False)), "_many": F.coalesce(many, F.lit(False))})
    # spanning items of the page, top first; a page's list is small
    centres = F.transform(F.array_sort(F.collect_list(F.when(F.col("_spans"), F.struct("top", "_x", "bottom", id_col, "_cy"))).over(page)), lambda s: s)
    rows = rows.withColumn("_list", centres)
    own = F.array_position(F.transform("_list", lambda s: s[id_col]), F.col(id_col))
    below = F.filter(F.transform("_list", lambda s, i: F.when(F.col("_cy") < s["_cy"] - 2.0, i + 1)), lambda i: i.isNotNull())
    segment = F.when(F.col("_spans"), own).when(F.col("_many"), F.coalesce(F.array_min(below).cast("long"), F.lit(1 << 30).cast("long"))).otherwise(F.lit(0).cast("long"))
    role = F.when(F.col("band").isNotNull(), F.col("band")).when(~F.col("in_body"), "unassigned").when(F.col("_spans"), "body_spanning").when(F.col("_many"), "column").otherwise("body")
    rank = F.when(role == "header", 0).when(role == "footer", 3).when(role == "unassigned", 2).otherwise(1)
    rows = rows.withColumns({"role": role, "_rank": rank, "_segment": segment, "_column": F.when(F.col("_many"), F.when(F.col("rtl"), -F.coalesce("column_index", F.lit(0))).otherwise(F.coalesce("column_index", F.lit(0)))).otherwise(0)})
    order = page.orderBy("_rank", "_segment", F.col("_spans").cast("int"), "_column", "top", "_x", "bottom", id_col)
    return rows.withColumn("reading_order", F.row_number().over(order)).drop("_cy", "_x", "_spans", "_many", "_list", "_rank", "_segment", "_column")


def section_groups(pages: DataFrame, doc_key: str, page_key: str, same: list[str]) -> DataFrame:
    """Adds section: numbers runs of pages of a document that agree in the given columns."""
    w = Window.partitionBy(doc_key).orderBy(page_key)
    now = F.struct(*same)
    new = F.coalesce((~now.eqNullSafe(F.lag(now).over(w))).cast("int"), F.lit(1))
    return pages.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("section", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def size_groups(pages: DataFrame, doc_key: str, page_key: str) -> DataFrame:
    """Adds size_group: the first group whose first page has the same size within max(1, 0.2 %)."""
    g = Window.partitionBy(doc_key)
    sizes = F.sort_array(F.collect_list(F.struct(F.col(page_key).alias("p"), F.col("page_width").alias("w"), F.col("page_height").alias("h"))).over(g))
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1.0), F.greatest(F.abs(a), F.abs(b)) * 0.002)
    start = F.struct(F.array().cast("array<struct<w:double,h:double>>").alias("firsts"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        hit = F.array_min(F.filter(F.transform(acc["firsts"], lambda f, i: F.when(near(f["w"], x["w"]) & near(f["h"], x["h"]), i + 1)), lambda i: i.isNotNull()))
        return F.struct(
            F.when(hit.isNull(), F.concat(acc["firsts"], F.array(F.struct(x["w"].alias("w"), x["h"].alias("h"))))).otherwise(acc["firsts"]).alias("firsts"),
            F.concat(acc["out"], F.array(F.coalesce(hit, F.size(acc["firsts"]) + 1))).alias("out"))

    place = F.row_number().over(g.orderBy(page_key))
    return pages.withColumn("_s", sizes).withColumn("size_group", F.element_at(F.aggregate("_s", start, step)["out"], place)).drop("_s")
