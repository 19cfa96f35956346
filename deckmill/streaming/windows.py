"""Windowed aggregates of events; each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return d.withWatermark("ts", late) if d.isStreaming else d


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows; rows later than the watermark are dropped by a stream."""
    g = _watermarked(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with gaps below ``gap``."""
    g = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs a query over what is there into a table in memory and stops."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
