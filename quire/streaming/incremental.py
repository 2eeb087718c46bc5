"""Incremental ingestion with Structured Streaming. An extension: the feature set this engine follows has no streams.

New files of documents are read as they come, lines are counted per normal form in the state store, and each batch's
counts are merged into a table, so that repeated lines can be told without reading old documents again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.scalars import digits_masked

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def documents_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(doc_id, text) of the Parquet files that come into folder."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def line_counts(docs: DataFrame) -> DataFrame:
    """(norm, n): how often each line, digits aside, has been seen so far; for update or complete mode."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text")).select(digits_masked("text").alias("norm"))
    return lines.filter("norm <> ''").groupBy("norm").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total): events (ts, event_type, value) by window; rows later than `late` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Works through all that has come and ends; each batch's changed rows replace the table's rows of the same lines.

    A batch writes a version of its own, so a batch that runs twice leaves the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(norm, n): the newest count of each line in the table that run_once writes."""
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy("norm").agg(F.max_by("n", "batch").alias("n"))
