"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
#: Rows of a bucket of a prefix sum, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 17, 16


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, size) rows to (source, source_size, weight, target): one row per source.

    Sources take the weights in turn, by code point, null last. All share total times the sum of
    sizes by weight; a source stops at `repeats` times its own size and the excess is shared
    anew. That level is found in closed form: in the order of cap / weight the stopped sources
    are a prefix, so one pass of prefix sums over the list of sources gives it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before_caps = F.sum("cap").over(upto) - F.col("cap")
    weights_left = F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")
    budget = F.sum("source_size").over(every) * F.lit(float(total))
    # the level if this source and all after it are still served; the first that is not above its cap holds
    each = each.withColumns({"level": budget - before_caps, "left": weights_left, "ord": F.row_number().over(by_ratio)})
    fits = F.col("level") * F.col("weight") <= F.col("cap") * F.col("left")
    first = F.min(F.when(fits, F.struct("ord", "level", "left"))).over(Window.partitionBy(F.lit(1)))
    each = each.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("ord") < F.col("first.ord")), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("first.level") / F.col("first.left"))
    return each.withColumn("target", target).select("source", "source_size", "weight", "target")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _identified(docs: DataFrame, stored: bool) -> DataFrame:
    """(at, row): each row as a struct, with the file and the place in it that a second read gives again.
    Unless docs is a plain read of Parquet files (stored), it is written first."""
    row = lambda d: d.select(F.struct(*(d.metadataColumn("_metadata")[c].alias(c) for c in ("file_path", "row_index"))).alias("at"), F.struct(*d.columns).alias("row"))
    if stored:
        try:
            return row(docs)
        except AnalysisException:  # no file source
            pass
    return row(cut(docs))


def _plan(rows: DataFrame, id_col, text_col, source_col, weights, total, repeats) -> tuple[DataFrame, DataFrame]:
    """The queue (at, id, source, size, h, ...) and the mixed stream (at, pass, virtual_finish, ...) up to the budget."""
    size, key = word_count(F.col("row")[text_col]), F.col("row")[id_col].cast("string")
    digest = F.coalesce(F.md5(key), F.md5(F.concat(F.lit("null "), size.cast("string"))))
    queue = cut(rows.select("at", F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"), size.alias("size"), digest.alias("h")))
    buckets = max(LEAST_BUCKETS, -(-queue.count() // BUCKET_ROWS))
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets).cast("int")
    queue = queue.withColumn("bucket", part)
    per_bucket = cut(queue.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(per_bucket, weights, total, repeats).withColumnRenamed("source", "s")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_bucket.select(F.col("source").alias("s0"), F.col("bucket").alias("b0"), (F.sum("size").over(running) - F.col("size")).alias("offset"))
    offsets = offsets.join(targets, _same("s0", "s")).select("s0", "b0", "offset", "source_size", "target")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("upto", F.sum("size").over(inner))
    queue = queue.join(offsets, _same("source", "s0") & (F.col("bucket") == F.col("b0")))
    queue = cut(queue.select("at", "id", "source", "size", "h", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start")))
    served = 2 * (F.col("start") + F.col("pass") * F.col("source_size")) + F.col("size")
    stream = queue.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    stream = stream.withColumn("virtual_finish", served.cast("double") / (2 * F.col("target")))
    # virtual time 1 serves the budget, so stretches of virtual time hold about as many words each
    stream = stream.withColumn("slot", F.floor(F.col("virtual_finish") * buckets).cast("long"))
    slots = cut(stream.groupBy("slot").agg(F.sum("size").alias("words")))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = slots.select(F.col("slot").alias("slot0"), (F.sum("words").over(upto) - F.col("words")).alias("served"))
    words = per_bucket.agg(F.sum("size").alias("words")).first().words or 0
    budget = words * min(float(total), float(repeats))
    inner = Window.partitionBy("slot").orderBy("virtual_finish", "h", "id", "size", F.col("source").asc_nulls_last(), "pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = stream.withColumn("upto", F.sum("size").over(inner)).join(slots, F.col("slot") == F.col("slot0"))
    return queue, stream.where(2 * (F.col("served") + F.col("upto")) - F.col("size") <= 2 * F.lit(budget))


def schedule(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, total=1.5, repeats=2, stored=False) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, start (words before it in its
    source's queue), times and taken (words that the mix takes, repeats counted).

    Within a source documents are shuffled by md5 of the id, and the queue runs `repeats` times. A
    document's virtual finish time is the number of its source's words up to it, divided by the
    source's target; documents stay whole, so one counts as finished at its middle. All queues are
    sorted by that time and the stream is truncated where it has served the total budget, so that a
    source misses its target by half a document and a like share of what the others miss.

    Only ids, sizes and sources are shuffled. Prefix sums come in two levels, hash buckets and then
    documents of a source's queue, stretches of virtual time and then documents of the stream, whose
    number grows with the rows, so that a source that holds most rows is spread.

    Null texts have size 0 and are never taken, a null source is a source, rows with a null id are
    shuffled by their size, ties follow id, size and source, and repeated rows each keep a place.
    Empty tables give empty results. Other columns of docs are ignored, whatever their names.
    """
    queue, stream = _plan(_identified(docs.select(id_col, text_col, source_col), stored), id_col, text_col, source_col, weights, total, repeats)
    times = stream.groupBy("at").agg(F.count("*").alias("times"))
    out = queue.join(times, "at", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return out.select("id", "source", "size", "source_size", "target", "start", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, total=1.5, repeats=2, stored=False) -> DataFrame:
    """The mixed stream of `schedule`: the rows of docs, one for each time taken, in the order of their
    virtual finish times (a global range sort). All columns of docs keep their names and values.
    stored says that docs is a plain read of Parquet files, which need not be written first."""
    rows = _identified(docs, stored)
    _, stream = _plan(rows, id_col, text_col, source_col, weights, total, repeats)
    places = stream.groupBy("at").agg(F.collect_list("virtual_finish").alias("finish"), F.first("h").alias("h"))
    out = rows.join(places, "at").select("row", "h", F.explode("finish").alias("finish"))
    return out.orderBy("finish", "h").select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken; nulls, ties and repeats as in schedule()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return schedule(docs, stored=True).select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, size, coalesce(md5(CAST(doc_id AS VARCHAR)), md5('null ' || size)) AS h FROM (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS ord,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS level,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS left_weight FROM w),
f AS (SELECT min(ord) AS ord, arg_min(level, ord) AS level, arg_min(left_weight, ord) AS left_weight FROM o WHERE level * weight <= cap * left_weight),
t AS (SELECT o.source, o.source_size, CASE WHEN f.ord IS NULL OR o.ord < f.ord THEN CAST(o.cap AS DOUBLE)
    ELSE o.weight * f.level / f.left_weight END AS target FROM o CROSS JOIN f),
q AS (SELECT row_number() OVER () AS k, d.*, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT q.*, pass, CAST(2 * (start + pass * source_size) + size AS DOUBLE) / (2 * target) AS finish FROM q CROSS JOIN range(2) r(pass) WHERE size > 0),
c AS (SELECT k, size, sum(size) OVER (ORDER BY finish, h, doc_id NULLS FIRST, size, source NULLS LAST, pass ROWS UNBOUNDED PRECEDING) AS upto FROM v),
n AS (SELECT k, count(*) AS times FROM c WHERE 2 * upto - size <= 2 * (SELECT sum(size) * CAST(1.5 AS DOUBLE) FROM d) GROUP BY k)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken FROM q LEFT JOIN n USING (k)
"""
