"""Ingress of page dictionaries and drawings, and the tables of spans, images and vectors that they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.functions.numbers import hex_of_unit, rgb
from pagelattice.operators.grouped import map_groups, worker_path
from pagelattice.operators.vectors import drawing_type

_BOX = "array<double>"
#: A page as layout extractors give it: blocks of type 0 hold lines of spans, type 1 an image.
PAGE = (
    "doc_id long, page_number int, width double, height double, rotation int, blocks array<struct<"
    f"type: int, number: int, bbox: {_BOX}, lines: array<struct<spans: array<struct<text: string, font: string, size: double, color: int, flags: int, bbox: {_BOX}, origin: {_BOX}>>>>,"
    "image: binary, ext: string, width: int, height: int, xres: int, yres: int, bpc: int, colorspace: int>>, "
    f"drawings array<struct<type: string, level: string, rect: {_BOX}, scissor: {_BOX}, fill: {_BOX}, color: {_BOX}, width: string, dashes: string, items: array<string>, path: array<struct<op: string, points: {_BOX}>>, even_odd: boolean>>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines files, with a fixed schema. A malformed line is a row of nulls with the line in
    corrupt_record, which is null otherwise, so that lines can be counted and none is lost."""
    return spark.read.schema(f"{PAGE}, corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_record").json(path)


def read_pdfs(spark: SparkSession, path: str, decode) -> DataFrame:
    """Pages of PDF files by a decoder, a function from bytes to rows of PAGE as dicts. No decoder
    library ships with this package; files are read by Spark, a row each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PAGE))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    worker_path(files)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows = [row for content in b.column(0).to_pylist() for row in decode(content)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(run, PAGE)


def _edges(c: Column) -> list[Column]:
    return [F.try_element_at(c, F.lit(k)).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"), 1)]


def spans(pages: DataFrame) -> DataFrame:
    """The fact table: one row per span of a text block, with its line and block, colour unpacked."""
    blocks = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_index", "b")).where("b.type = 0")
    lines = blocks.select("doc_id", "page_number", F.coalesce("b.number", "block_index").alias("block_number"), F.posexplode("b.lines").alias("line_index", "l"))
    s = lines.select("doc_id", "page_number", "block_number", "line_index", F.posexplode("l.spans").alias("span_index", "s"))
    return s.select(
        "doc_id", "page_number", "block_number", "line_index", "span_index", F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.font").alias("font"), F.col("s.size").alias("font_size"), "s.color", rgb(F.coalesce("s.color", F.lit(0))).alias("rgb"), F.coalesce("s.flags", F.lit(0)).alias("flags"),
        *_edges(F.col("s.bbox")), F.try_element_at("s.origin", F.lit(1)).alias("origin_x"), F.try_element_at("s.origin", F.lit(2)).alias("origin_y"))


def lines(spans_: DataFrame, keys=("doc_id", "page_number", "block_number", "line_index")) -> DataFrame:
    """One row per line with visible text: envelope, baseline, median font and text by left edge."""
    v = spans_.where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("left", "span_index", "text")))
    return v.groupBy(*keys).agg(
        *(f(c).alias(c) for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))), F.median("origin_y").alias("baseline"), F.median("font_size").alias("font_size"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def images(pages: DataFrame) -> DataFrame:
    """Image blocks with defaults: png, 72 dots per inch, 8 bits."""
    b = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_index", "b")).where("b.type = 1")
    of = lambda c, other: F.coalesce(F.col(f"b.{c}"), F.lit(other)).alias(c)
    return b.select("doc_id", "page_number", F.coalesce("b.number", "block_index").alias("block_number"), *_edges(F.col("b.bbox")), F.col("b.image").alias("data"), of("ext", "png"), of("width", 0), of("height", 0), of("xres", 72), of("yres", 72), of("bpc", 8), of("colorspace", 0))


def vectors(pages: DataFrame) -> DataFrame:
    """Painted drawings with a box, numbered in the order of the page, with their paths and the clips that hold for them.

    A clip holds until a row of its level or a lower one follows: one pass over a page's rows, with a
    stack of clips whose levels rise. Null levels count as 0; the rows of equal pages run together.
    """
    d = pages.select("doc_id", "page_number", F.posexplode("drawings").alias("seq", "d"))
    painted = F.coalesce(F.col("d.type").isin("f", "s", "fs") & F.col("d.rect").isNotNull(), F.lit(False))
    d = d.select("doc_id", "page_number", "seq", F.coalesce(F.expr("try_cast(d.level as int)"), F.lit(0)).alias("level"), F.coalesce(F.col("d.type") == "clip", F.lit(False)).alias("clip"), painted.alias("painted"), F.col("d.scissor").alias("box"), "d.rect", "d.items", "d.fill", "d.color", "d.width", "d.dashes", "d.path", "d.even_odd")
    kept = ("doc_id", "page_number", "seq", "level", "rect", "items", "fill", "color", "width", "dashes", "path", "even_odd")

    def fold(rows):
        clips: list[dict] = []
        for r in rows:
            if r["painted"]:
                yield {**{c: r[c] for c in kept}, "clips": [c for c in clips if c["level"] < r["level"]]}
            while clips and clips[-1]["level"] >= r["level"]:
                clips.pop()
            if r["clip"]:
                clips.append({"level": r["level"], "box": r["box"], "path": r["path"], "even_odd": r["even_odd"]})

    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField("clips", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("box", T.ArrayType(T.DoubleType())), d.schema["path"], d.schema["even_odd"]])))])
    d = map_groups(d, ["doc_id", "page_number"], ["seq"], fold, schema)
    color = lambda c: hex_of_unit(*[F.try_element_at(F.col(c), F.lit(k)) for k in (1, 2, 3)])
    return d.select(
        "doc_id", "page_number", (F.col("seq") + 1).alias("sequence_number"), "level", *_edges(F.col("rect")), drawing_type(F.coalesce("items", F.array().cast("array<string>"))).alias("drawing_type"),
        color("fill").alias("fill_color"), color("color").alias("stroke_color"), F.coalesce(F.expr("try_cast(width as double)"), F.lit(0.0)).alias("stroke_width"), "dashes", "clips", "path", "even_odd")
