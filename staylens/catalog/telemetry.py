"""Telemetry rollups in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import Tables
from staylens.operators import telemetry
from staylens.session import shared_dir
from staylens.streaming import metrics, reviews


@query("a10_counter_rollup", """
    select model, success, count(*) as events from {telemetry} group by 1, 2""")
def _(t: Tables):
    return telemetry.counter_rollup(t.telemetry, ["model", "success"])


@query("a10_errors_by_type", """
    select metric, safe, count(*) as events from {telemetry} where metric = 'error' group by 1, 2""")
def _(t: Tables):
    errors = t.telemetry.filter("metric = 'error'")
    return telemetry.counter_rollup(errors, ["metric", "safe"])


BUCKET = "coalesce((select min(b) from unnest([{}]) as u(b) where value <= b), 'inf'::double)".format(
    ", ".join(f"{float(b)}::double" for b in telemetry.BOUNDS)
)


@query("a11_histogram_rollup", f"""
    with bucketed as (select *, {BUCKET} as bucket from {{telemetry}})
    select type, model, cast(bucket as string) as bucket, count(*) as events,
        round(sum(value), 4) as total, min(value) as low, max(value) as high
    from bucketed group by 1, 2, 3""")
def _(t: Tables):
    out = telemetry.histogram_rollup(t.telemetry, ["type", "model"])
    return out.withColumns(
        {"bucket": F.col("bucket").cast("string"), "total": F.round("total", 4)}
    )


@query("a11_token_histogram", """
    with usage as (select model, cast(user_id % 4 as int) as p, cast(event_id % 3 as int) as c
        from {telemetry} join (select event_id, user_id from {events}) using (event_id)),
    tokens as (select model, 'prompt' as type, p as value from usage where p > 0 or c > 0
        union all select model, 'completion', c from usage where p > 0 or c > 0)
    select type, model, count(*) as events, cast(sum(value) as double) as total from tokens
    group by 1, 2""")
def _(t: Tables):
    usage = t.events.select(
        F.concat(F.lit("model_"), F.col("user_id") % 3).alias("model"),
        (F.col("user_id") % 4).alias("prompt_tokens"), (F.col("event_id") % 3).alias("completion_tokens"),
    )
    tokens = telemetry.recorded_tokens(usage)
    return tokens.groupBy("type", "model").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    )


@query("a11_quantile_rollup", """
    select metric, model, count(*) as events, quantile_disc(value, 0.5) as q50,
        quantile_disc(value, 0.9) as q90, quantile_disc(value, 0.99) as q99
    from {telemetry} group by 1, 2""")
def _(t: Tables):
    out = telemetry.quantile_rollup(t.telemetry, ["metric", "model"], [0.5, 0.9, 0.99])
    named = [F.col("quantiles")[i].alias(f"q{q}") for i, q in enumerate((50, 90, 99))]
    return out.select("metric", "model", "events", *named)


@query("a12_gauge_last", """
    select metric, model, arg_max(value, (ts, event_id)) as value from {telemetry} group by 1, 2""")
def _(t: Tables):
    return telemetry.gauge_last(t.telemetry, ["metric", "model"]).select("metric", "model", "value")


def streamed(t: Tables, table: str) -> Tables:
    """The same tables with one given table read as a file stream."""
    name = f"{table}.parquet"
    given = t.spark.read.parquet(f"{t.folder.rstrip('/')}/{name}")
    local = [c for c, kind in given.dtypes if kind == "timestamp_ntz"]
    # The source wants a folder; the filter picks the table in it.
    reader = t.spark.readStream.schema(given.schema).option("pathGlobFilter", name)
    stream = reader.parquet(t.folder)
    live = Tables(t.spark, t.folder)
    live._made[table] = stream.withColumns({c: F.col(c).cast("timestamp") for c in local})
    return live


def run_to_end(df: DataFrame, spark) -> DataFrame:
    """Run a stream over what is there and read back what it appended."""
    out = shared_dir(spark, "windows")
    started = (
        df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


# Fixed value: delay after which a window is final, in minutes.
DELAY = 10
WINDOWED = """
    select strftime(w, '%Y-%m-%d %H:%M') as window_start, {keys}, count(*) as events,
        round(sum(value), 4) as total, min(value) as low, max(value) as high
    from (select *, {start} as w from {{telemetry}}{more})
    where w + interval {size} hour <= (select max(ts) from {{telemetry}}) - interval {delay} minute
    group by w, {keys}"""


def starts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm"),
        "total": F.round("total", 4),
    }).drop("window_end")


@query("t2_stream_counters", WINDOWED.format(
    keys="metric", start="date_trunc('hour', ts)", more="", size=1, delay=DELAY))
def _(t: Tables):
    live = streamed(t, "events").telemetry
    counted = metrics.windowed_counters(live, ["metric"], "1 hour", delay=f"{DELAY} minutes")
    return starts(run_to_end(counted, t.spark))


@query("t2_stream_sliding", WINDOWED.format(
    keys="model", start="date_trunc('hour', ts) - to_hours(back)",
    more=", (select unnest(range(0, 6)) as back)", size=6, delay=DELAY))
def _(t: Tables):
    live = streamed(t, "events").telemetry
    counted = metrics.windowed_counters(live, ["model"], "6 hours", "1 hour", f"{DELAY} minutes")
    return starts(run_to_end(counted, t.spark))


@query("t2_batch_histograms", f"""
    select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M') as window_start, model,
        cast({BUCKET} as string) as bucket, count(*) as events, round(sum(value), 4) as total,
        min(value) as low, max(value) as high
    from {{telemetry}} group by 1, 2, 3""")
def _(t: Tables):
    out = metrics.windowed_histograms(t.telemetry, ["model"], "1 day")
    return starts(out.withColumn("bucket", F.col("bucket").cast("string")))


@query("t1_stream_new_reviews", """
    select distinct source, md5(review_text) as source_review_id from {reviews}""")
def _(t: Tables):
    rows = t.reviews.withColumn("source_review_id", F.md5("review_text"))
    out = shared_dir(t.spark, "reviews")
    # Several landings, the newest reviews first; each becomes a batch of its own.
    rows.repartitionByRange(4, F.desc("review_date")).write.parquet(f"{out}/landed")
    live = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed")
    reviews.stream_new_reviews(live, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    stored = t.spark.read.schema(live.schema).parquet(f"{out}/data")
    return stored.select("source", "source_review_id")
