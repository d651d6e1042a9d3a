"""Captures as a stream: repeated fetches dropped within a watermark, failures counted in windows.

The reference works on one site at a time and has no stream; these are the two steps that a continuous crawl needs
before the batch plans, with state bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_captures(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files of a folder (or one file); the schema is that of what is there now."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return r.parquet(path)


def first_fetches(captures: DataFrame, delay: str = "2 days") -> DataFrame:
    """Of the fetches of a page within the delay only the first to arrive. Rows without id or time are left out."""
    c = captures.where("page_id IS NOT NULL AND fetched_at IS NOT NULL").withColumn("at", F.col("fetched_at").cast("timestamp"))
    return c.withWatermark("at", delay).dropDuplicatesWithinWatermark(["page_id"])


def failures_by_window(captures: DataFrame, window: str = "30 days", delay: str = "2 days") -> DataFrame:
    """Fetches and failures per site and tumbling window; a window is final once the watermark has passed it."""
    c = captures.where("fetched_at IS NOT NULL").withColumn("at", F.col("fetched_at").cast("timestamp"))
    failed = F.coalesce("status", F.lit(0)).isin(0) | (F.coalesce("status", F.lit(0)) >= 400)
    g = c.withWatermark("at", delay).groupBy("site_id", F.window("at", window).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("fetches"), F.count_if(failed).alias("failures")).select(
        "site_id", F.col("w.start").alias("start"), "fetches", "failures"
    )


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there and stop; the sink is a folder of Parquet files, exactly once by the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
