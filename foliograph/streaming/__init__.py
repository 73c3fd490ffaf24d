"""Pages as they arrive: an extension, as the batch operators have no counterpart of it.

A folder of page deliveries is read as a stream; each micro-batch is projected by the same expressions as a
batch and merged into tables, keyed by page, so that a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliograph.functions import text as T


def page_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Parquet deliveries of pages as they are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of page files as they appear or change."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[mM][dD]").load(folder)
    return rows.select("path", "modificationTime", F.decode("content", "utf-8").alias("content"))


def link_events(stream: DataFrame, time: str = "loaded_at", late: str = "1 hour") -> DataFrame:
    """Links per graph, title and hour of delivery, with a watermark for late ones; a page counts once an hour."""
    rows = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["page_id", time])
    each = rows.select("graph_path", time, F.explode(T.links(F.coalesce("raw_content", F.lit("")))).alias("title"))
    return each.groupBy(F.window(time, "1 hour").alias("hour"), "graph_path", "title").agg(F.count("*").alias("links"))


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``step`` on every micro-batch; with ``once``, on all there is now and then ends."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_by_key(spark: SparkSession, batch: DataFrame, table: str, key: list[str], order: str, version: int) -> None:
    """The newest row of each key of a batch merged into a versioned parquet table; version n replaces n - 1.

    Each version is a folder of its own, so a failed batch leaves the last one whole and a repeated batch writes
    the same again.
    """
    rows = batch
    if version > 0:
        rows = spark.read.parquet(f"{table}/v{version - 1}").unionByName(batch)
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    newest.write.mode("overwrite").parquet(f"{table}/v{version}")
