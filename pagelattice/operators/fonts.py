"""Document statistics over lines and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def font_statistics(spans: DataFrame, keys: list[str], size: str, order: list[str]) -> DataFrame:
    """Largest, smallest and most frequent font size per key; of equally frequent ones the first seen.

    Sizes are rounded to a tenth. Two aggregations: per size, then per key.
    """
    rows = spans.select(*keys, F.round(size, 1).alias("_s"), F.struct(*order).alias("_at"))
    per_size = rows.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    first = F.struct((-F.col("_n")).alias("n"), F.col("_at"))
    return per_size.groupBy(*keys).agg(F.max("_s").alias("largest"), F.min("_s").alias("smallest"), F.min_by("_s", first).alias("most_common"))
