"""Styled runs: spans of a line to runs, lines of a paragraph to flowing text, folded in order in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.text import NO_BLANK_BEFORE, inline_text, needs_blank, strip

RUN = "struct<text:string,font:string,size:double,bold:boolean,italic:boolean,color:int>"
# Words that end a line whole, so that a lone letter after them isn't their last.
WHOLE_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
LINE_FILL = 0.8


def _style(s: Column) -> list[Column]:
    return [s["font"].alias("font"), s["size"].alias("size"), s["bold"].alias("bold"), s["italic"].alias("italic"), s["color"].alias("color")]


def _run(text: Column, s: Column) -> Column:
    return F.struct(text.alias("text"), *_style(s)).cast(RUN)


def line_runs(spans: DataFrame, keys: list[str], size_tolerance: float = 0.01) -> DataFrame:
    """keys, runs of each line: its spans from left to right, with a blank where one belongs.

    spans: left, right, text, font, font_size, bold, italic, color. Blank spans are passed over. A span joins the
    run before it if it has the style of the span before and the size of the run's head; one without a finite size, bold or italic
    stands alone. Blanks go to the run before them. Only heads are folded in order, so that a line costs its length.
    """
    s = spans.withColumn("_t", inline_text("text")).where(strip("_t") != "")
    row = F.struct("left", "right", F.col("_t").alias("raw"), strip("_t").alias("text"), "font", F.col("font_size").alias("size"), "bold", "italic", "color")
    lines = s.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("s"))
    size_of = lambda x, y: F.abs(x["size"] - y["size"]) <= F.lit(float(size_tolerance))
    clean = lambda x: F.coalesce(x["bold"].isNotNull() & x["italic"].isNotNull() & size_of(x, x), F.lit(False))

    def told(x, k):
        p, n = F.get("s", k - 1), F.get("s", k + 1)
        same = x["font"].eqNullSafe(p["font"]) & (x["bold"] == p["bold"]) & (x["italic"] == p["italic"]) & x["color"].eqNullSafe(p["color"])
        blank = n.isNotNull() & needs_blank(x["raw"], n["raw"], n["left"] - x["right"], F.least(x["size"], n["size"]))
        return F.struct(x["text"].alias("text"), *_style(x), clean(x).alias("clean"), F.coalesce(same & clean(x) & clean(p), F.lit(False)).alias("same"), F.coalesce(blank, F.lit(False)).alias("blank"))

    def step(acc, x):
        near = F.coalesce(x["same"] & size_of(acc, x), F.lit(False))
        heads = F.when(near, acc["heads"]).otherwise(F.concat(acc["heads"], F.array(acc["k"])))
        return F.struct(F.when(near, acc["size"]).otherwise(x["size"]).alias("size"), (acc["k"] + 1).alias("k"), heads.alias("heads"))

    def made(head, j):
        x, end = F.get("t", head), F.coalesce(F.get("heads", j + 1), F.size("t"))
        words = F.transform(F.slice("t", head + 1, end - head), lambda y: F.concat(y["text"], F.when(y["blank"] & y["clean"], " ").otherwise("")))
        run = _run(F.array_join(words, ""), x)
        return F.when(x["blank"] & ~x["clean"], F.array(run, _run(F.lit(" "), x))).otherwise(F.array(run))

    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("heads"))
    lines = lines.select(*keys, F.transform("s", told).alias("t"))
    lines = lines.select(*keys, "t", F.aggregate("t", start, step, lambda acc: acc["heads"]).alias("heads"))
    return lines.select(*keys, F.flatten(F.transform("heads", made)).alias("runs"))


def flow(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, text: a paragraph's lines as flowing text.

    Between lines comes a blank, but not after a hyphen or before closing punctuation. A lone small
    letter at the head of a line is the end of the word before it, if that line is at least 0.8 full
    and the word has three letters and isn't a common whole one. lines: text, left, right.
    """
    w = Window.partitionBy(*keys)
    full = (F.col("right") - F.min("left").over(w)) / F.greatest(F.max("right").over(w) - F.min("left").over(w), F.lit(1.0))
    rows = lines.withColumn("_full", full)
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, strip("text").alias("t"), F.col("_full").alias("f")))).alias("p"))
    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("f"))

    def step(acc, x):
        head, tail = F.regexp_extract(x["t"], r"^([a-z])(?:\s|$)", 1), F.regexp_extract(acc["text"], "([A-Za-z]+)$", 1)
        broken = (head != "") & (F.char_length(tail) >= 3) & ~F.lower(tail).isin(*WHOLE_WORDS) & (acc["f"] >= LINE_FILL)
        rest = strip(F.substr(x["t"], F.lit(2)))
        closed = F.lit(NO_BLANK_BEFORE).contains(F.substring(x["t"], 1, 1)) | acc["text"].endswith("-")
        text = (
            F.when(acc["text"] == "", x["t"]).when(x["t"] == "", acc["text"])
            .when(broken, F.concat(acc["text"], head, F.when(rest == "", "").otherwise(F.concat(F.lit(" "), rest))))
            .when(closed, F.concat(acc["text"], x["t"])).otherwise(F.concat(acc["text"], F.lit(" "), x["t"])))
        return F.struct(text.alias("text"), x["f"].alias("f"))

    return parts.select(*keys, F.aggregate("p", start, step)["text"].alias("text"))


def without_marker(text: Column, marker: Column) -> Column:
    """The text of a list item without its marker and the blanks around it."""
    t = F.ltrim(text)
    return F.when(marker.isNotNull() & t.startswith(marker), F.regexp_replace(F.substr(t, F.char_length(marker) + 1), r"(?U)^\s+", "")).otherwise(text)
