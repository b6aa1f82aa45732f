"""Incremental work on streams of files: latest pages, and politeness of fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import quality_score, simhash64
from quern.functions.urls import canonical_url, registrable_domain
from quern.operators.places import upsert_latest
from quern.sources.web import PAGE


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Stream of page records from JSON lines that arrive in a folder."""
    return spark.readStream.schema(PAGE).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)


def page_features(pages: DataFrame) -> DataFrame:
    """What of the signals needs only the page itself."""
    t = pages.where("status = 200 AND url IS NOT NULL")
    return t.select("url", "crawled_at_unix", canonical_url(F.col("url")).alias("canonical"), quality_score(F.col("title"), F.col("body_text")).alias("quality"), simhash64(F.col("body_text")).alias("simhash"))


def follow_pages(stream: DataFrame, folder: str, checkpoint: str):
    """Start writing page features to a folder, one sub-folder a batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        page_features(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_features(spark: SparkSession, folder: str) -> DataFrame:
    """The latest features of each address over all batches."""
    return upsert_latest(spark.read.parquet(folder), "url", "crawled_at_unix").drop("batch")


def arrivals_by_hour(stream: DataFrame, time: str, late: str = "2 hours") -> DataFrame:
    """Counts by hour of event time; rows later than ``late`` behind the newest are left out of a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def politeness_gaps(fetches: DataFrame, least_ms: int) -> DataFrame:
    """(domain, url, at, gap_ms): fetches that came too soon after the one before on their domain."""
    by = Window.partitionBy("domain").orderBy("at", "url")
    f = fetches.withColumn("domain", registrable_domain(F.col("url"))).withColumn("gap_ms", (F.col("at") - F.lag("at").over(by)) * 1000)
    return f.where(F.col("gap_ms") < least_ms).select("domain", "url", "at", "gap_ms")
