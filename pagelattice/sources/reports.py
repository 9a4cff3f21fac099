"""JSON reports: rows as JSON text, in files by Spark or one indented file by the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One column, json, of each row; nulls are kept as null members."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def write_report(summary: DataFrame, issues: DataFrame, path: str) -> None:
    """One indented UTF-8 file of a document's summary row and its issues, for a single document."""
    rows = lambda df: [json.loads(r.json) for r in as_json(df).toLocalIterator()]
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps({"summary": rows(summary), "issues": rows(issues)}, ensure_ascii=False, indent=2), encoding="utf-8")
