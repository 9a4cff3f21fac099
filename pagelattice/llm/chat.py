"""Chat formatting in budgeted windows, in DataFrame functions only.

A window is text such as

    <|turn|>system<|text|>...<|end|><|again|>user<|text|>...<|end|><|turn|>assistant<|text|>...<|end|>

<|turn|> opens a turn that the window holds for the first time, <|again|> one that an earlier window
has had: the system turn, which every window keeps, and the history before the window. Control
strings inside roles and texts are broken by a backslash, and backslashes are doubled, so that the
text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import WORD, cut

BUDGET = 512
HISTORY = 128
#: Tokens that a turn's marks count for.
MARKS = 4
#: Turn numbers of one block of the prefix sums.
BLOCK = 1024
NEW, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>"
# Control strings of common chat templates begin so; each is broken after its first character.
CONTROL = r"<(?=\|)|\[(?=/?INST\]|/?SYS)|<(?=/?s>|<SYS>>|</SYS>>)"


def escape(c: str | Column) -> Column:
    doubled = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formats conversations: conv_id, window, formatted, loss (spans of code points), n_new, tokens.

    Turns are ordered by turn, nulls first, then role and text, so that ties and repeated rows have
    a fixed order; null roles and texts count as empty, a null conv_id is a conversation of its own,
    and extra columns are ignored. A turn's tokens are its words and MARKS. The first turn, if its
    role is system, is repeated in every later window; what it and the history leave of the budget
    is a window's room. Prefix sums of tokens are laid over a raster of that room: turns within a
    cell are a window, and a turn across a cell's end joins them if it fits, or else is a window of
    its own. From the window before, turns that begin at most `history` tokens before this one are
    repeated as far as the budget goes. So a window is over the budget only where the system turn and
    one other turn alone are. The loss covers each assistant text once, where it is new.

    Texts are shuffled to number the turns, to meet their windows and to form them; all else is
    done on numbers.
    """
    text = F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    t = t.withColumns({"tokens": (F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long"), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))})
    # prefix sums in two levels, blocks of turn numbers and then turns, so that a long conversation is spread
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = cut(t.select("conv_id", "block", "role", "text", "tokens", F.sum("tokens").over(inner).alias("t1"), F.count("*").over(inner).alias("n1")))
    sums = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *((F.sum(x).over(blocks) - F.col(x)).alias(f"{x}0") for x in "tn"))
    k = t.select("conv_id", "block", "n1", "t1", "tokens", (F.col("role") == "system").alias("says"))
    k = k.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    k = cut(k.select("conv_id", "block", "n1", "tokens", "says", (F.col("n0") + F.col("n1")).alias("pos"), (F.col("t0") + F.col("t1") - F.col("tokens")).alias("before")))
    first = (F.col("pos") == 1) & F.col("says")
    system = k.where(first).select("conv_id", "block", "n1", "tokens")
    own = system.select(F.col("conv_id").alias("c"), F.col("tokens").alias("s"))
    rest = k.where(~first).join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c", "says").withColumn("s", F.coalesce("s", F.lit(0)))
    rest = rest.withColumns({"before": F.col("before") - F.col("s"), "room": F.greatest(F.lit(budget - history) - F.col("s"), F.lit(1))})
    rest = rest.withColumns({"cell": F.floor(F.col("before") / F.col("room")), "across": F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room")) > F.floor(F.col("before") / F.col("room"))})
    full = F.sum("tokens").over(Window.partitionBy("conv_id", "cell")) > F.col("room")
    rest = cut(rest.withColumn("key", 2 * F.col("cell") + F.when(F.col("across") & full, 1).otherwise(0)))
    spans = rest.groupBy("conv_id", "key").agg(F.min("before").alias("first"), F.sum("tokens").alias("new"), F.first("s").alias("s"))
    ordered = Window.partitionBy("conv_id").orderBy("key")
    spans = spans.withColumns({"w": F.row_number().over(ordered) - 1, "left": F.least(F.lit(history), F.lit(budget) - F.col("s") - F.col("new"))})
    spans = cut(spans.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "w", F.lead("first").over(ordered).alias("next"), F.lead("left").over(ordered).alias("left")))
    rest = rest.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    place = ("conv_id", "block", "n1", "pos")
    new = rest.select(*place, "w", F.lit(True).alias("new"))
    past = rest.where(F.col("next") - F.col("before") <= F.col("left")).select(*place, F.col("w") + 1, F.lit(False))
    opening = system.select("conv_id", "block", "n1", F.lit(1).cast("long").alias("pos"), F.lit(0).alias("w"), F.lit(True))
    kept = system.join(spans.where("w > 0"), F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "n1", F.lit(1).cast("long"), "w", F.lit(False))
    every = new.union(past).union(opening).union(kept).toDF("c", "b", "i", "pos", "window", "new")
    every = every.join(t, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("n1") == F.col("i")))
    mark = F.when(F.col("new"), F.lit(NEW)).otherwise(F.lit(AGAIN))
    lead = F.char_length(mark) + F.char_length(escape("role")) + F.char_length(F.lit(TEXT))
    piece = F.concat(mark, escape("role"), F.lit(TEXT), escape("text"), F.lit(END))
    row = F.struct("pos", piece.alias("piece"), lead.alias("at"), F.char_length(escape("text")).alias("size"), ((F.col("role") == "assistant") & F.col("new")).alias("loss"), "new")
    out = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("tokens").alias("tokens"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, r):
        here = F.when(r["loss"], F.array(F.struct((acc["at"] + r["at"]).cast("long").alias("start"), r["size"].cast("long").alias("length"))))
        here = F.coalesce(here, F.array().cast("array<struct<start:bigint,length:bigint>>"))
        return F.struct((acc["at"] + F.char_length(r["piece"])).alias("at"), F.concat(acc["spans"], here).alias("spans"))

    return out.select(
        "conv_id", "window", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.aggregate("rows", start, step)["spans"].alias("loss"), F.size(F.filter("rows", lambda r: r["new"])).alias("n_new"), "tokens")


def read_turns(formatted: str | Column = "formatted") -> Column:
    """The new turns of a window, in order: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|(?=turn\||again\|)"), lambda p: p.startswith("turn|>"))
    part = lambda p, k: unescape(F.split(F.substring(p, 7, 2**31 - 8), r"<\|text\|>|<\|end\|>", -1)[k])
    return F.transform(pieces, lambda p: F.struct(part(p, 0).alias("role"), part(p, 1).alias("text")))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """The texts under the mask of a window, in order and unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, digests read back from the windows; nulls, ties and repeats as in windows()."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    made = windows(turns.unionByName(extra))
    lines = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select("conv_id", "window", F.char_length("formatted").alias("n"), read_turns().alias("said"), F.array_join(read_loss(), "").alias("loss"))
    said = read.select("conv_id", "window", "n", lines.alias("turns"), "loss", F.size("said").alias("k"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("formatted_chars"), F.sum("k").alias("n_turns"))
    whole = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return rows.select(
        "conv_id", F.col("n_turns").cast("long"), F.sha2(whole("turns"), 256).alias("turns_sha256"),
        F.char_length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
