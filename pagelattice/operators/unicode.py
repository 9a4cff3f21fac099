"""What Spark has no built-in for: NFKC, case folding and reading direction, as Arrow functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RTL, LTR = {"R", "AL", "RLE", "RLO", "RLI", "AN"}, {"L", "LRE", "LRO", "LRI"}


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # ASCII texts, the bulk, are their own normal form and skip Python's work
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(run(c))


def casefold(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.casefold())

    return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.lower(c)).otherwise(run(c))


def direction_counts(c: Column) -> Column:
    """struct(rtl, ltr): how many characters of a text run right to left and left to right."""

    @F.pandas_udf("rtl long, ltr long")
    def run(s: pd.Series) -> pd.DataFrame:
        kinds = s.map(lambda t: [unicodedata.bidirectional(x) for x in (t or "")])
        return pd.DataFrame({"rtl": kinds.map(lambda k: sum(x in RTL for x in k)), "ltr": kinds.map(lambda k: sum(x in LTR for x in k))})

    return run(c)


def is_rtl(rtl: Column, ltr: Column) -> Column:
    """Of a page's summed counts: right to left if at least three characters have a direction and most run so."""
    return (rtl + ltr >= 3) & (rtl > ltr)
