"""Documents beside their pages: what a decoder tells of a file, with its metadata as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document as a decoder gives it.
DOCUMENT = "doc_id long, is_pdf boolean, is_encrypted boolean, needs_pass boolean, permissions long, metadata map<string, string>"
# The names that files have for their metadata, and those of the columns.
METADATA = {
    "format": "format", "title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "creator": "creator", "producer": "producer", "creationDate": "created", "modDate": "modified", "trapped": "trapped", "encryption": "encryption"}
_DATE = r"^(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(Z|[+-]\d\d'?(?:\d\d)?'?)?"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines files, with a fixed schema; a malformed line is a row of nulls with the line in corrupt_record."""
    return spark.read.schema(f"{DOCUMENT}, corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_record").json(path)


def pdf_date(c: Column) -> Column:
    """The instant of a date such as D:20240131235959+01'30', in which all behind the year may be left out; null for
    texts that aren't one. Dates without an offset are in UTC."""
    part = lambda k, other: F.coalesce(F.nullif(F.regexp_extract(c, _DATE, k), F.lit("")), F.lit(other))
    stamp = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("+00:00"))
    offset = F.replace(part(7, "Z"), F.lit("'"), F.lit(""))
    minutes = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    return F.when(c.rlike(_DATE), F.timestamp_seconds(F.unix_micros(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX"))) / 1000000 - sign * minutes * 60))


def document_info(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: doc_id, page_count, is_pdf, is_encrypted, needs_pass, permissions, and metadata as columns
    (title, author, ..., created and modified as timestamps).

    page_count is the number of different pages, 0 without any. Missing flags are false, missing permissions 0, and blank
    metadata null. Pages of documents that aren't told of give no row.
    """
    count = pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("page_count"))
    told = lambda k: F.nullif(F.trim(F.try_element_at("metadata", F.lit(k))), F.lit(""))
    named = [(pdf_date(told(k)) if k.endswith("Date") else told(k)).alias(n) for k, n in METADATA.items()]
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in ("is_pdf", "is_encrypted", "needs_pass")]
    return documents.join(count, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), *flags, F.coalesce("permissions", F.lit(0)).cast("long").alias("permissions"), *named)
