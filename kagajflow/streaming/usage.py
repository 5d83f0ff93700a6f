"""Usage in time windows, for batches and streams. An extension: there is no streaming in the portal whose operators these are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type: how many, and their values' sum. Later than `late` they don't count."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: runs of events with no pause of `gap`."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def write_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows to Parquet until the files at hand are read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
