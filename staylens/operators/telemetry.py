"""Counters, histograms and gauges over search telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.operators.ranges import weighted_ranks

# Upper bounds of the histogram buckets (the last bucket is open).
BOUNDS = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]


def counter_rollup(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events per attribute combination."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"))


def bucket_bound(value: Column, bounds: list[float] = BOUNDS) -> Column:
    """Upper bound of the bucket a value falls in; infinity past the last bound."""
    out = F.lit(float("inf"))
    for bound in sorted(bounds, reverse=True):
        out = F.when(value <= float(bound), F.lit(float(bound))).otherwise(out)
    return out


def recorded_tokens(usage: DataFrame) -> DataFrame:
    """Token measurements by type; a call without any tokens records nothing."""
    some = usage.filter((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0))
    return some.select(
        "model",
        F.explode(
            F.array(
                F.struct(F.lit("prompt").alias("type"), F.col("prompt_tokens").alias("value")),
                F.struct(
                    F.lit("completion").alias("type"), F.col("completion_tokens").alias("value")
                ),
            )
        ).alias("m"),
    ).select("model", "m.type", F.col("m.value").cast("double").alias("value"))


def histogram_rollup(events: DataFrame, keys: list[str], bounds: list[float] = BOUNDS) -> DataFrame:
    """Bucket counts with the sum and range of the values in each bucket."""
    bucketed = events.withColumn("bucket", bucket_bound(F.col("value"), bounds))
    return bucketed.groupBy(*keys, "bucket").agg(
        F.count("value").alias("events"),
        F.sum("value").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def quantile_rollup(events: DataFrame, keys: list[str], shares: list[float],
                    parts: int | None = None) -> DataFrame:
    """Exact quantiles: the smallest value that at least the given share of values does not exceed.

    Equal values are counted map-side first. The different values of a group are then
    ranked by ranges, so that no task holds all values of a large group.
    """
    per_value = events.groupBy(*keys, "value").agg(F.count("value").alias("_n"))
    ranks = weighted_ranks(per_value, keys, "value", "_n", shares, parts)
    return ranks.withColumnsRenamed({"total": "events", "values": "quantiles"})


def gauge_last(events: DataFrame, keys: list[str]) -> DataFrame:
    """Last value per key; equal times are settled by the larger event id."""
    last = F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id"))
    return events.groupBy(*keys).agg(last.alias("_l")).select(
        *keys, F.col("_l.value").alias("value"), F.col("_l.ts").alias("ts")
    )
