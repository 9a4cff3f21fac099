"""Vector drawings: type, category, chart components and drawing groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, contains_center
from pagelattice.operators.grouped import map_groups

# Fills that count as white, and thresholds in points or shares.
WHITES = ("#FFFFFF", "#FEFEFE", "#FDFDFD")
PAGE_COVERAGE, EDGE_MARGIN, DECORATION_SIZE = 0.9, 30.0, 25.0
BULLET_SIZE, LONG_LINE, THIN_LINE = (2.0, 12.0), 80.0, 5.0
CHART_DISTANCE, CHART_EDGE, CHART_MEMBERS, CHART_SIZE = 55.0, 40.0, 8, (120.0, 70.0)
CHART_COVERAGE, CHART_LONG_LINES, CHART_MARKS = 0.7, 2, 3
GROUP_DISTANCE, GROUP_WIDTH, GROUP_HEIGHT, GROUP_AREA = 12.0, 0.9, 0.55, 0.45


def drawing_type(ops: Column) -> Column:
    """Kind of a drawing from the operators of its path (array of l, c, re, qu)."""
    d = F.array_distinct(ops)
    only = lambda op: (F.size(d) == 1) & F.array_contains(d, op)
    return (
        F.when(F.size(d) == 0, "unknown").when(only("re"), "rectangle").when(only("l"), "line").when(only("c"), "curve")
        .when(only("qu"), "quadrilateral").otherwise("compound"))


def _touches(b: Box, width: float, height: float, margin: float) -> Column:
    return (b.left <= margin) | (b.top <= margin) | (b.right >= width - margin) | (b.bottom >= height - margin)


def first_category(b: Box, fill: Column, width: float, height: float) -> Column:
    """background, noise, decorative or null (still open), tested in this order."""
    large = (b.width >= DECORATION_SIZE) | (b.height >= DECORATION_SIZE)
    coverage = b.width * b.height / F.lit(max(width * height, 1.0))
    return (
        F.when((coverage >= PAGE_COVERAGE) & fill.isin(*WHITES), "background")
        .when((b.width <= 1.0) & (b.height <= 1.0), "noise")
        .when(fill.isNotNull() & ~fill.isin(*WHITES) & large & _touches(b, width, height, EDGE_MARGIN), "decorative"))


def last_category(b: Box, fill: Column, kind: Column) -> Column:
    low, high = BULLET_SIZE
    bullet = fill.isNotNull() & b.width.between(low, high) & b.height.between(low, high) & kind.isin("curve", "compound")
    separator = (kind == "line") & (((b.width >= LONG_LINE) & (b.height <= THIN_LINE)) | ((b.height >= LONG_LINE) & (b.width <= THIN_LINE)))
    return F.when(bullet, "bullet").when(separator, "separator").otherwise("unknown")


def may_chart(b: Box, kind: Column, width: float, height: float) -> Column:
    return kind.isin("line", "curve", "rectangle", "compound") & ~_touches(b, width, height, CHART_EDGE)


def _near(a, b, margin):
    return max(b[0] - a[2], a[0] - b[2], 0.0) <= margin and max(b[1] - a[3], a[1] - b[3], 0.0) <= margin


def components(boxes: DataFrame, keys: list[str], id_col: str, names=("left", "top", "right", "bottom"), margin: float = CHART_DISTANCE) -> DataFrame:
    """keys, id, component: connected boxes within a margin on both axes; the smallest id names them.

    One page's boxes are swept by their left edges, so that only boxes within reach are compared.
    """
    schema = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys) + f", `{id_col}` {boxes.schema[id_col].dataType.simpleString()}, component {boxes.schema[id_col].dataType.simpleString()}"

    def label(rows):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        open_: list[int] = []
        box = [tuple(r[n] for n in names) for r in rows]
        for i in range(len(rows)):
            open_ = [j for j in open_ if box[j][2] + margin >= box[i][0]]
            for j in open_:
                if _near(box[j], box[i], margin):
                    root[find(i)] = find(j)
            open_.append(i)
        least: dict[int, object] = {}
        for i, r in enumerate(rows):
            x = find(i)
            least[x] = min(least.get(x, r[id_col]), r[id_col])
        for i, r in enumerate(rows):
            yield {**{k: r[k] for k in keys}, id_col: r[id_col], "component": least[find(i)]}

    return map_groups(boxes.select(*keys, id_col, *names), keys, [names[0], id_col], label, schema)


def categories(vectors: DataFrame, keys: list[str], id_col: str, width: float, height: float, b: Box | None = None, least_members: int = CHART_MEMBERS) -> DataFrame:
    """vectors with category and should_render: background, noise, decorative, chart, bullet, separator, unknown.

    Needs left..bottom, fill_color, stroke_color, stroke_width and drawing_type. A chart is a
    connected component of drawings away from the page's edge with enough members, extent, long
    lines, marks and colours; a page needs at least least_members candidates.
    """
    b = b or Box.of()
    kind, fill, stroke = F.col("drawing_type"), F.col("fill_color"), F.col("stroke_color")
    v = vectors.withColumn("_first", first_category(b, fill, width, height))
    page = Window.partitionBy(*keys)
    open_ = v.where(F.col("_first").isNull() & may_chart(b, kind, width, height)).withColumn("_n", F.count("*").over(page)).where(F.col("_n") >= least_members)
    mark = F.when(kind == "line", stroke.isNotNull() & (F.col("stroke_width") >= 1.5) & (b.width <= 130) & (b.height <= 180)).otherwise((b.width <= 110) & (b.height <= 230))
    long = (b.width >= LONG_LINE) | (b.height >= LONG_LINE)
    parts = components(open_.select(*keys, id_col, *(c.alias(n) for c, n in zip(b, Box._fields, strict=True))), keys, id_col)
    known = open_.join(parts, [*keys, id_col])
    extent = {"w": F.max(b.right) - F.min(b.left), "h": F.max(b.bottom) - F.min(b.top)}
    charts = known.groupBy(*keys, "component").agg(
        F.count("*").alias("n"), extent["w"].alias("w"), extent["h"].alias("h"), F.count_if(long).alias("lines"), F.count_if(mark).alias("marks"), F.count_distinct(F.coalesce(stroke, fill)).alias("colors"))
    charts = charts.where(
        (F.col("n") >= least_members) & (F.col("w") >= CHART_SIZE[0]) & (F.col("h") >= CHART_SIZE[1]) & (F.col("w") * F.col("h") / F.lit(max(width * height, 1.0)) <= CHART_COVERAGE)
        & (F.col("lines") >= CHART_LONG_LINES) & (F.col("marks") >= CHART_MARKS) & (F.col("colors") >= 2)).select(*keys, "component")
    members = parts.join(charts, [*keys, "component"], "left_semi").select(*keys, id_col, F.lit(True).alias("_chart"))
    out = v.join(members, [*keys, id_col], "left")
    category = F.coalesce("_first", F.when(F.col("_chart"), "chart"), last_category(b, fill, kind))
    out = out.withColumn("category", category).drop("_first", "_chart")
    return out.withColumn("should_render", ~F.col("category").isin("background", "noise", "chart", "bullet"))


def groups(vectors: DataFrame, keys: list[str], id_col: str, width: float, height: float) -> DataFrame:
    """Greedy groups of drawings of one category, visited from the top, then from the left, ties by id: keys,
    id, group_number and the group's envelope (group_left, group_top, group_right, group_bottom).

    A drawing joins the nearest group that has its category, lies within 12 points and may grow by
    it, and else begins one. Groups never merge, so the visit order counts.
    """
    names = Box._fields
    schema = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys) + f", `{id_col}` {vectors.schema[id_col].dataType.simpleString()}, group_number int, group_left double, group_top double, group_right double, group_bottom double"

    def gap(a, b):
        return max(b[0] - a[2], a[0] - b[2], 0.0), max(b[1] - a[3], a[1] - b[3], 0.0)

    def strong(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return False
        small = [min(a[k + 2] - a[k], b[k + 2] - b[k]) for k in (0, 1)]
        areas = min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
        return (w >= 0.2 * small[0] and h >= 0.2 * small[1]) or w * h >= 0.15 * areas

    def fits(members, box):
        env = [f(m[k] for m in [*members, box]) for k, f in enumerate((min, min, max, max))]
        w, h = (env[2] - env[0]) / max(width, 1.0), (env[3] - env[1]) / max(height, 1.0)
        return not ((w > GROUP_WIDTH and h > GROUP_HEIGHT) or (w * h > GROUP_AREA and len(members) + 1 > 2))

    def assign(rows):
        made: list[tuple[set, list]] = []
        placed = []
        for r in rows:
            box, best = tuple(r[n] for n in names), None
            for k, (kinds, members) in enumerate(made):
                gaps = [gap(m, box) for m in members]
                if r["category"] not in kinds or not any(max(g) <= GROUP_DISTANCE for g in gaps):
                    continue
                if not (any(strong(m, box) for m in members) or fits(members, box)):
                    continue
                far = min((x * x + y * y) ** 0.5 for x, y in gaps)
                if best is None or far < best[0]:
                    best = far, k
            if best is None:
                made.append(({r["category"]}, [box]))
                best = 0.0, len(made) - 1
            else:
                made[best[1]][0].add(r["category"])
                made[best[1]][1].append(box)
            placed.append((r, best[1]))
        edges = [[float(f(m[k] for m in members)) for k, f in enumerate((min, min, max, max))] for _, members in made]
        for r, k in placed:
            yield {**{c: r[c] for c in keys}, id_col: r[id_col], "group_number": k + 1, **dict(zip(("group_left", "group_top", "group_right", "group_bottom"), edges[k], strict=True))}

    return map_groups(vectors.select(*keys, id_col, "category", *names), keys, [names[1], names[0], id_col], assign, schema)


def outside_tables(vectors: DataFrame, tables: DataFrame, keys: list[str], b: Box, t: Box) -> DataFrame:
    """vectors whose centre lies in no table of the same page; t names columns of tables."""
    return vectors.join(tables, [vectors[k] == tables[k] for k in keys] + [contains_center(t, b)], "left_anti")
