"""Structured Streaming forms of the feeds: deduplication, daily progression and
an append-only log. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_detections(df: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Detections once, though requests overlap; state goes after the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def progression(df: DataFrame, ts: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window of event time."""
    by = df.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"))
    return by.agg(F.count("*").alias("detections"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), "detections", "total", "largest")


def append(df: DataFrame, path: str, checkpoint: str):
    """Run what is there to Parquet, once; returns the finished query."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
