"""Paragraphs from lines: fragments to rows, rows to paragraphs, paragraph spacing, vector bullets."""

from __future__ import annotations

import re
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, touches
from pagelattice.functions.text import BULLETS, NUMBER_BODY
from pagelattice.operators.grouped import map_groups

CENTER, OVERLAP, GAP, FONT = 3.0, 0.6, 24.0, 0.75
LEFT, ADVANCE = 8.0, (2.0, 1.8)
ENDS = (".", "!", "?", ";", ":")
CHART_MARGINS = (45.0, 30.0, 45.0, 45.0)
_MARKER = re.compile(rf"^\s*([{BULLETS}]|\(\s*{NUMBER_BODY}\s*\)|{NUMBER_BODY}[.)])(\s+|$)")


def outside_chart(lines: DataFrame, vectors: DataFrame, keys: list[str], b: Box) -> DataFrame:
    """lines that the envelope of their page's charts, with its margins, doesn't touch; captions stay."""
    left, top, right, bottom = CHART_MARGINS
    env = vectors.where("category = 'chart'").groupBy(*keys).agg((F.min("left") - left).alias("c_left"), (F.min("top") - top).alias("c_top"), (F.max("right") + right).alias("c_right"), (F.max("bottom") + bottom).alias("c_bottom"))
    joined = lines.join(env, keys, "left")
    keep = F.col("c_left").isNull() | F.col("text").rlike(r"(?i)^\(\s*Figure\b") | ~touches(b, Box.of("c_"))
    return joined.where(keep).drop("c_left", "c_top", "c_right", "c_bottom")


def _same_row(a: dict, b: dict) -> bool:
    centers = abs((a["top"] + a["bottom"]) / 2 - (b["top"] + b["bottom"]) / 2)
    overlap = max(min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]), 0.0) / max(min(a["bottom"] - a["top"], b["bottom"] - b["top"]), 0.01)
    return (centers <= CENTER or overlap >= OVERLAP) and _gap(a, b) <= GAP and abs(a["font_size"] - b["font_size"]) <= FONT


def _gap(a: dict, b: dict) -> float:
    return max(b["left"] - a["right"], a["left"] - b["right"], 0.0)


def _rows(fragments: list[dict]) -> list[dict]:
    """Fragments joined to the row with the smallest gap; a row's box and font follow its members."""
    rows: list[dict] = []
    for f in fragments:
        near = [(k, _gap(r, f)) for k, r in enumerate(rows) if _same_row(r, f)]
        if not near:
            rows.append({**f, "members": [f]})
            continue
        r = rows[min(near, key=lambda x: x[1])[0]]
        r["members"] = sorted([*r["members"], f], key=lambda m: m["left"])
        for k, pick in (("left", min), ("top", min), ("right", max), ("bottom", max)):
            r[k] = pick(m[k] for m in r["members"])
        r["font_size"] = median(m["font_size"] for m in r["members"])
        r["text"] = " ".join(m["text"].strip() for m in r["members"])
    return sorted(rows, key=lambda r: (r["top"], r["left"]))


def _content_left(first: dict) -> float:
    """Where the text of a paragraph begins: past a list marker, by the mean width of a character."""
    head = first["members"][0]
    text = head["text"].lstrip()
    found = _MARKER.match(text)
    if not found:
        return first["left"]
    if not text[found.end() :].strip() and len(first["members"]) > 1:
        return first["members"][1]["left"]
    width = max(head["right"] - head["left"], 0.0) / max(len(text), 1) or max(head["font_size"] * 0.48, 1.0)
    inner = head["left"] + width * (len(head["text"]) - len(text) + found.end())
    return min(max(inner, head["left"] + max(head["font_size"] * 0.9, 8.0)), head["right"])


def _goes_on(group: list[dict], row: dict) -> bool:
    last, text = group[-1], row["text"].strip()
    font = max(last["font_size"], row["font_size"], 1.0)
    advance = row["top"] - last["top"]
    if abs(last["font_size"] - row["font_size"]) > FONT or not text or _MARKER.match(text):
        return False
    if abs(row["left"] - _content_left(group[0])) > max(LEFT, 0.9 * font) or not ADVANCE[0] <= advance <= ADVANCE[1] * font:
        return False
    if {m["block"] for m in last["members"]} & {m["block"] for m in row["members"]}:
        return True
    before = last["text"].rstrip()
    return bool(before) and (before.endswith("-") or not before.endswith(ENDS))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (block, line_index, text, font_size, left..bottom) to paragraphs of a page.

    keys, region_number (1, 2, ..), text (rows joined by line ends), box, content_left, line_count,
    marker, blocks. The result depends on the visit order, top then left, and is one pass per page.
    """
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", region_number int, text string, left double, top double, right double, bottom double, content_left double, line_count int, marker string, blocks array<int>"

    def build(found):
        groups: list[list[dict]] = []
        for row in _rows(found):
            if groups and _goes_on(groups[-1], row):
                groups[-1].append(row)
            else:
                groups.append([row])
        for number, g in enumerate(groups, 1):
            marker = _MARKER.match(g[0]["text"].strip())
            yield {
                **{k: g[0][k] for k in keys}, "region_number": number, "text": "\n".join(r["text"].strip() for r in g), **{k: pick(r[k] for r in g) for k, pick in (("left", min), ("top", min), ("right", max), ("bottom", max))},
                "content_left": _content_left(g[0]), "line_count": len(g), "marker": marker[1] if marker else None, "blocks": sorted({m["block"] for r in g for m in r["members"]})}

    return map_groups(lines, keys, ["top", "left", "line_index"], build, schema)


def attach_bullets(paragraphs_: DataFrame, bullets: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The bullet drawing of each paragraph: keys, paragraph id, bullet id.

    In the paragraphs' order each takes the best free bullet: within its first line's height, at most
    36 points to its left, scored by vertical distance and a tenth of the gap. Candidates come from a
    range join by page; only these reach the greedy pass.
    """
    p = paragraphs_.select(*keys, F.col(id_col).alias("_p"), F.col("left").alias("_l"), F.col("first_top").alias("_t"), F.col("first_bottom").alias("_b"))
    c = bullets.select(*keys, F.col("bullet_id"), "left", "top", "right", "bottom")
    dy = F.abs((F.col("top") + F.col("bottom")) / 2 - (F.col("_t") + F.col("_b")) / 2)
    gap = F.col("_l") - F.col("right")
    limit = F.greatest(F.lit(5.0), F.greatest(F.col("_b") - F.col("_t"), F.lit(1.0)) * 0.75)
    pairs = p.join(c, keys).where((dy <= limit) & gap.between(-3.0, 36.0)).select(*keys, "_p", "bullet_id", (dy + F.greatest(gap, F.lit(0.0)) * 0.1).alias("score"))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{id_col}` {types['_p']}, bullet_id {types['bullet_id']}"

    def take(rows):
        used, done = set(), set()
        for r in rows:
            if r["_p"] not in done and r["bullet_id"] not in used:
                done.add(r["_p"])
                used.add(r["bullet_id"])
                yield {**{k: r[k] for k in keys}, id_col: r["_p"], "bullet_id": r["bullet_id"]}

    return map_groups(pairs, keys, ["_p", "score", "bullet_id"], take, schema)


def spacing(paragraphs_: DataFrame, keys: list[str], order: list[str], baseline: Column, line_spacing: Column) -> DataFrame:
    """Adds spacing_before: distance of baselines less the larger line spacing, 0 up to one point."""
    w = Window.partitionBy(*keys).orderBy(*order)
    free = baseline - F.lag(baseline).over(w) - F.greatest(line_spacing, F.lag(line_spacing).over(w))
    return paragraphs_.withColumn("spacing_before", F.when(free > 1, free).otherwise(F.lit(0.0)))


def split_blocks(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds run: paragraphs of a block, split at blank lines and where the font differs by more than
    half a point from the first line of the run (an ordered fold, since that line moves)."""
    g = Window.partitionBy(*keys)
    rows = lines.withColumn("_f", F.sort_array(F.collect_list(F.struct(*order, F.col("font_size").alias("s"), (F.trim("text") == "").alias("e"))).over(g)))
    start = F.struct(F.lit(0).alias("run"), F.lit(None).cast("double").alias("font"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = acc["font"].isNull() | (F.abs(x["s"] - acc["font"]) > 0.5)
        run = acc["run"] + F.when(new, 1).otherwise(0)
        on = F.struct(run.alias("run"), F.when(new, x["s"]).otherwise(acc["font"]).alias("font"), F.concat(acc["out"], F.array(run)).alias("out"))
        off = F.struct(acc["run"].alias("run"), F.lit(None).cast("double").alias("font"), F.concat(acc["out"], F.array(F.lit(None).cast("int"))).alias("out"))
        return F.when(x["e"], off).otherwise(on)

    place = F.row_number().over(g.orderBy(*order))
    return rows.withColumn("run", F.element_at(F.aggregate("_f", start, step)["out"], place)).drop("_f")


def indents(paragraphs_: DataFrame, keys: list[str], block_type: str = "block_type") -> DataFrame:
    """Adds left_indent and right_indent against the envelope of the page's text, page numbers left out."""
    w = Window.partitionBy(*keys)
    body = lambda f, c: f(F.when(F.col(block_type) != "page_number", F.col(c))).over(w)
    return paragraphs_.withColumns({"left_indent": F.greatest(F.col("left") - body(F.min, "left"), F.lit(0.0)), "right_indent": F.greatest(body(F.max, "right") - F.col("right"), F.lit(0.0))})
