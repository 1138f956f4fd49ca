"""Hourly aggregation of an event stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """location, time, temp, dew, n of each hour; on a stream, hours close when the watermark passes them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    out = timed.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("location")).agg(
        F.avg("value").alias("temp"), F.min("value").alias("dew"), F.count("*").alias("n")
    )
    return out.select("location", F.col("window.start").alias("time"), "temp", "dew", "n")


def start(events: DataFrame, path: str, checkpoint: str, lateness: str = "2 hours"):
    """Write closed hours as Parquet, each once; the checkpoint lets a lost query go on where it was."""
    stream = hourly(events, lateness).writeStream.outputMode("append").format("parquet")
    return stream.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_updates(events: DataFrame, path: str, checkpoint: str, lateness: str = "2 hours"):
    """Write the hours that each batch changes, open ones included, in a folder of the batch; ``latest`` reads them.

    State ends with the watermark, and what a batch writes grows with its hours,
    not with all hours so far. A batch that is run again replaces its folder.
    """

    def write(hours: DataFrame, batch: int) -> None:
        hours.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = hourly(events, lateness).writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each hour as the last batch that changed it left it."""
    rows = spark.read.parquet(path).groupBy("location", "time").agg(F.max_by(F.struct("temp", "dew", "n"), "batch").alias("_last"))
    return rows.select("location", "time", "_last.temp", "_last.dew", "_last.n")
