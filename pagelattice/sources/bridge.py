"""Layout views over star-schema, text and event tables, in Spark SQL and in DuckDB SQL.

`box` and `line` are deterministic by modular arithmetic, so that both engines see the same rows.
Each view is one SQL text; only the line split differs between the two dialects.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0

BOX = """
SELECT l_orderkey AS page_number, l_linenumber AS box_id,
  CAST((l_partkey*7919) % 500 AS DOUBLE) AS l,
  CAST((l_suppkey*1047 + l_linenumber*97) % 700 AS DOUBLE) AS t,
  CAST((l_partkey*7919) % 500 AS DOUBLE) + CAST(10 AS DOUBLE) + CAST(l_quantity AS DOUBLE)*4 AS r,
  CAST((l_suppkey*1047 + l_linenumber*97) % 700 AS DOUBLE) + CAST(8 AS DOUBLE) + CAST(l_linenumber AS DOUBLE)*6 AS b
FROM lineitem
"""
RAW_SPARK = "SELECT doc_id, pos AS ln, col AS txt FROM documents LATERAL VIEW posexplode(split(text, '\\n')) pe AS pos, col"
RAW_DUCKDB = "SELECT doc_id, g-1 AS ln, string_split(text, chr(10))[g] AS txt FROM documents, generate_series(1, len(string_split(text, chr(10)))) q(g)"
LINE = """
SELECT doc_id, CAST(floor(ln/40) AS INT)+1 AS page_number, CAST(ln AS INT) AS line_index,
  concat(CASE ln % 9 WHEN 1 THEN '1. ' WHEN 2 THEN '• ' WHEN 3 THEN 'a) ' WHEN 4 THEN '(iv) '
         WHEN 5 THEN '1.2. ' WHEN 6 THEN 'v. ' WHEN 7 THEN 'B) ' ELSE '' END, trim(txt)) AS text,
  CAST(10.0+((doc_id*31+ln*7)%5)*0.5 AS DOUBLE) AS font_size,
  CAST(72.0+18.0*((doc_id+ln)%3) AS DOUBLE) AS l, CAST(72.0+16.0*(ln%40) AS DOUBLE) AS t,
  CAST(72.0+18.0*((doc_id+ln)%3) AS DOUBLE) + least(CAST(length(trim(txt)) AS DOUBLE)*CAST(5 AS DOUBLE), CAST(440 AS DOUBLE)) AS r,
  CAST(72.0+16.0*(ln%40) AS DOUBLE) + CAST(12 AS DOUBLE) AS b
FROM raw WHERE length(trim(txt)) > 0
"""
# A drawing on each box: type, colours, stroke and path operators by arithmetic.
VECTOR = """
SELECT page_number, CAST(row_number() OVER (PARTITION BY page_number ORDER BY l, t, r, b, box_id) AS INT) AS box_id, l, t,
  CASE box_id % 4 WHEN 0 THEN l + CAST(6 AS DOUBLE) ELSE r END AS r,
  CASE box_id % 4 WHEN 0 THEN t + CAST(6 AS DOUBLE) WHEN 1 THEN t + CAST(2 AS DOUBLE) ELSE b END AS b,
  CASE box_id % 4 WHEN 0 THEN 'curve' WHEN 1 THEN 'line' WHEN 2 THEN 'rectangle' ELSE 'compound' END AS drawing_type,
  CASE page_number % 3 WHEN 0 THEN '#FFFFFF' WHEN 1 THEN '#336699' ELSE NULL END AS fill_color,
  CASE WHEN box_id % 2 = 1 THEN '#000000' END AS stroke_color,
  CAST(box_id AS DOUBLE) / 2 AS stroke_width
FROM box
"""


#: Rows of a table, times the weight of the work on one, for each task of dealt().
ROWS = 150_000


def parts(spark: SparkSession, sf_dir: str, weight: float = 1.0, table: str = "lineitem") -> int:
    """Partitions for work by key on rows made of a table: in proportion to its rows, which the files tell without being
    read, and no fewer than the session has for shuffles."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * weight / ROWS))


def dealt(spark: SparkSession, sf_dir: str, df: DataFrame, *keys: str, weight: float = 1.0) -> DataFrame:
    """df dealt by its keys over parts(). Windows and groups by them, and more columns, need no other shuffle, and what a task
    holds stays as it is when the input grows."""
    return df.repartition(parts(spark, sf_dir, weight), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table below the folder that spark.checkpoint.dir names, so that plans over it are short, its work is done once
    and Spark knows its size; a temporary folder where Spark runs in one local process. On a cluster without such a folder it
    is df itself."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = sc.getConf().get("spark.checkpoint.dir", None)
        if not set_dir and not re.match(r"local(\[[^-]*\])?$", sc.master):
            return df
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="pagelattice-"))
    path = f"{sc.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The DataFrame of a layout view: box, line or vector, or a table of sf_dir."""
    if name == "box":
        return spark.sql(BOX.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if name == "vector":
        return spark.sql(VECTOR.replace("FROM box", "FROM {box}"), box=view(spark, sf_dir, "box"))
    if name == "line":
        raw = spark.sql(RAW_SPARK.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return spark.sql(LINE.replace("FROM raw", "FROM {raw}"), raw=raw)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duckdb(*names: str) -> str:
    """WITH clause that defines the named views for DuckDB; later clauses may follow after a comma."""
    need = {n: None for n in (("box",) if {"box", "vector"} & set(names) else ())}
    if "vector" in names:
        need["vector"] = None
    if "line" in names:
        need |= {"raw": None, "line": None}
    text = {"box": BOX, "vector": VECTOR, "raw": RAW_DUCKDB, "line": LINE}
    return "WITH " + ", ".join(f"{n} AS ({text[n]})" for n in need)
