"""Micro-batches of new page files: spans are appended as pages arrive; a page is the unit of work,
so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelattice.sources.pages import PAGE, spans, vectors


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Reads JSON page files as they appear in source; writes spans and vectors below target.

    The checkpoint makes files count once; a batch that is run again overwrites its own folder, so
    a lost driver or executor leaves no duplicates.
    """
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch, epoch):
        for name, made in (("spans", spans(batch)), ("vectors", vectors(batch))):
            made.write.mode("overwrite").parquet(f"{target}/{name}/batch={epoch}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
