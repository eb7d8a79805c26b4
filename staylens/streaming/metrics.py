"""Windowed telemetry, the same plan for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.operators.telemetry import bucket_bound


def windowed_counters(events: DataFrame, keys: list[str], size: str, slide: str | None = None,
                      delay: str = "10 minutes") -> DataFrame:
    """Counts and value ranges per time window; rows later than ``delay`` are dropped."""
    return _windowed(events, keys, size, slide, delay)


def windowed_histograms(events: DataFrame, keys: list[str], size: str, slide: str | None = None,
                        delay: str = "10 minutes") -> DataFrame:
    """Bucket counts per time window."""
    bucketed = events.withColumn("bucket", bucket_bound(F.col("value")))
    return _windowed(bucketed, [*keys, "bucket"], size, slide, delay)


def _windowed(events: DataFrame, keys: list[str], size: str, slide: str | None,
              delay: str) -> DataFrame:
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", size, slide or size), *keys).agg(
        F.count("*").alias("events"),
        F.sum("value").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, "events", "total", "low", "high",
    )
