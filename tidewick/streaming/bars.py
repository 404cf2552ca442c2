"""Bars from a stream of events: the same aggregation over a table and, with a watermark, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str | None = None) -> DataFrame:
    """Hourly bars of each event type; `late` is how long a stream waits for late events."""
    key = F.struct("ts", "event_id")
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").alias("w")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", key).alias("open"), F.max_by("value", key).alias("close"), F.count("*").alias("volume"),
    ).select("symbol", F.col("w.start").alias("bar_time"), "low", "high", "open", "close", "volume")


def stream_bars(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, late: str = "2 hours"):
    """A query that appends finished hours to a Parquet table, exactly once, and ends when all files are read."""
    events = spark.readStream.schema(schema).parquet(folder)
    return hourly_bars(events, late).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
