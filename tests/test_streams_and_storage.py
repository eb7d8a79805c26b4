import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staylens import schemas
from staylens.operators import telemetry
from staylens.session import shared_dir
from staylens.sources import files, sinks, tables
from staylens.streaming import metrics, reviews


def test_stream_inserts_once_across_runs(spark, tmp_path, rows):
    shape = "source string, source_review_id string, review_text string, review_date timestamp"
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def land(*data):
        df = spark.createDataFrame(data, "source string, source_review_id string, review_text string, d string")
        df.withColumn("review_date", F.to_timestamp("d")).drop("d").coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(shape).parquet(inbox)
        reviews.stream_new_reviews(stream, target, checkpoint).awaitTermination()
        return rows(spark.read.schema(shape).parquet(target), "source", "source_review_id", "review_text")

    land(("g", "1", "a", "2024-01-01 00:00:00"), ("g", "1", "a", "2024-01-01 00:10:00"), ("y", "1", "b", "2024-01-01"))
    assert run() == [("g", "1", "a"), ("y", "1", "b")]
    # Far later, the state has expired; the stored keys still count.
    land(("g", "2", "c", "2024-03-01"), ("g", "", "d", "2024-03-01"))
    run()
    land(("g", "1", "again", "2024-03-02"), ("g", " ", "d", "2024-03-02"))
    got = run()
    assert len(got) == 4 and ("g", "1", "again") not in got
    # A new key is stored whatever its date.
    land(("g", "3", "newest", "2024-05-01"))
    run()
    land(("g", "4", "old", "2020-01-01"), ("g", "4", "repeated", "2020-01-02"))
    got = run()
    assert ("g", "4", "old") in got and len(got) == 6


def test_stream_writes_a_file_per_bucket(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(3000).select(
        F.lit("g").alias("source"), F.col("id").cast("string").alias("source_review_id"),
        F.lit("a").alias("review_text"), F.to_timestamp(F.lit("2024-01-01")).alias("review_date"),
    ).write.parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        reviews.stream_new_reviews(stream, target, checkpoint).awaitTermination()
    finally:
        spark.conf.unset(coalesce)
    files_of = lambda d: len([f for f in os.listdir(d) if f.endswith(".parquet")])
    buckets = [f"{target}/batch=0/{d}" for d in os.listdir(f"{target}/batch=0") if d.startswith("bucket=")]
    assert len(buckets) == reviews.BUCKETS and all(files_of(d) == 1 for d in buckets)
    assert spark.read.parquet(target).count() == 3000


@pytest.fixture
def events(spark):
    data = [(1, "2024-01-01 00:01:00", "m", 2.0), (2, "2024-01-01 00:59:59", "m", 8.0),
            (3, "2024-01-01 01:00:00", "m", 20.0), (4, "2024-01-01 00:01:00", "n", 99999.0),
            (5, "2024-01-01 00:01:00", "n", 1.0)]
    df = spark.createDataFrame(data, "event_id int, t string, metric string, value double")
    return df.withColumn("ts", F.to_timestamp("t")).drop("t")


def test_windows_equal_in_batch_and_stream(spark, tmp_path, events, rows):
    inbox = str(tmp_path / "in")
    events.coalesce(1).write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).parquet(inbox)
    live = metrics.windowed_counters(stream, ["metric"], "1 hour")
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.windowed_counters(events, ["metric"], "1 hour")
    assert rows(spark.table("live")) == rows(batch) and batch.count() == 3
    sliding = metrics.windowed_counters(events, ["metric"], "2 hours", "1 hour")
    assert sliding.agg(F.sum("events")).head()[0] == 10


def test_late_rows_are_dropped(spark, tmp_path, rows):
    inbox, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    shape = "ts timestamp, metric string, value double"
    for i, t in enumerate(["2024-01-01 00:30:00", "2024-01-01 05:00:00", "2024-01-01 00:40:00", "2024-01-01 09:00:00"]):
        df = spark.createDataFrame([(t, "m", float(i))], "t string, metric string, value double")
        df.select(F.to_timestamp("t").alias("ts"), "metric", "value").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(shape).parquet(inbox)
        counted = metrics.windowed_counters(stream, ["metric"], "1 hour", delay="10 minutes")
        counted.writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(out).select(F.hour("window_start"), "events", "total"))
    assert got == [(0, 1, 0.0), (5, 1, 1.0)]


def test_histogram_and_gauge(events, rows):
    got = rows(telemetry.histogram_rollup(events, ["metric"]), "metric", "bucket", "events")
    assert got == [("m", 10.0, 1), ("m", 25.0, 1), ("m", 5.0, 1), ("n", 5.0, 1), ("n", float("inf"), 1)]
    assert rows(telemetry.gauge_last(events, ["metric"]), "metric", "value") == [("m", 20.0), ("n", 1.0)]


def test_tokens_without_usage_are_skipped(spark, rows):
    df = spark.createDataFrame([("a", 0, 0), ("a", 3, 0), ("b", 1, 2)], "model string, prompt_tokens int, completion_tokens int")
    assert rows(telemetry.recorded_tokens(df)) == [
        ("a", "completion", 0.0), ("a", "prompt", 3.0), ("b", "completion", 2.0), ("b", "prompt", 1.0)
    ]


def test_airports_file(spark, tmp_path, rows):
    good = '1,"Goroka, Intl","Goroka","Papua New Guinea","GKA","AYGA",-6.08,145.39,5282,10,"U","P/M","airport","X"'
    (tmp_path / "airports.dat").write_text(
        f"{good}\n{good},extra\n" + good.rsplit(",", 1)[0] + "\n" + good.replace('"GKA"', r"\N") + "\n"
    )
    got = rows(files.read_airports(spark, str(tmp_path / "airports.dat")), "name", "iata", "source")
    assert got == [("Goroka, Intl", "GKA", "X"), ("Goroka, Intl", "GKA", "X"), ("Goroka, Intl", r"\N", "X")]


def test_countries_file(spark, tmp_path, rows):
    (tmp_path / "countries.dat").write_text(
        '"Old",FR,"FR"\n"Korea, North",KP,KN\nshort,XX\n"France", FR ,"FX"\nGermany,DE,DE\n'
    )
    assert rows(files.read_countries(spark, str(tmp_path))) == [("France", "FR", "FR,FX"), ("Germany", "DE", "DE")]


def test_city_files(spark, tmp_path, rows):
    (tmp_path / "europeCities.txt").write_text("Paris, France\nRome,Italy,x\n\n")
    (tmp_path / "misc.txt").write_text("Lima,Peru")
    (tmp_path / "other.csv").write_text("No,No")
    assert rows(files.read_city_files(spark, str(tmp_path))) == [
        ("Lima", "Peru", "notdetected"), ("Paris", " France", "europe")
    ]


def test_saved_pages(spark, tmp_path, rows):
    for path in ("New York,United States/reviews-a+b-1.html", "Oslo,Norway/12_x_y.html", "Oslo,Norway/skip.txt"):
        file = tmp_path / path
        file.parent.mkdir(exist_ok=True)
        file.write_text("<p>\nx</p>")
    got = rows(files.read_saved_pages(spark, str(tmp_path)))
    assert got == [
        ("New York,United States/reviews-a+b-1.html", "<p>\nx</p>"), ("Oslo,Norway/12_x_y.html", "<p>\nx</p>")
    ]
    only = files.read_saved_pages(spark, str(tmp_path), reviews_only=True)
    assert only.count() == 1


def test_sinks(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.create_if_absent(spark, df.schema, path)
    assert spark.read.schema(df.schema).parquet(path).count() == 0
    sinks.append(df, path)
    sinks.create_if_absent(spark, df.schema, path)
    assert spark.read.parquet(path).count() == 2
    sinks.overwrite(df.limit(1), path, schemas.table("id long, v string"))
    assert dict(spark.read.parquet(path).dtypes)["id"] == "bigint"
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1
    with pytest.raises(ValueError):
        sinks.materialise(df, "x", "cube")
    sinks.materialise(df, "kept_table", "table")
    sinks.materialise(df.limit(1), "kept_table", "table")
    assert spark.table("kept_table").count() == 1


def test_jsonl_skips_bad_lines(spark, tmp_path, rows):
    (tmp_path / "x.json").write_text('{"id":1,"more":2}\n{"id":"x"}\nnot json\n{"id":3}\n')
    assert rows(sinks.load_jsonl(spark, str(tmp_path), "id int")) == [(1,), (3,)]


def test_point_lookup(spark, rows):
    df = spark.range(5)
    assert rows(tables.by_id(df, "3")) == [(3,)] and rows(tables.by_id(df, 9)) == []
    with pytest.raises(ValueError):
        tables.by_id(df, "x")


def test_shared_dir_follows_the_cluster(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scan_checked(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("1", 5, 2.0), ("x", 6, None), (None, 7, 1e10)], "Id string, n long, v double").write.parquet(
        f"{folder}/t.parquet")
    wanted = StructType.fromDDL("id int, v int, n bigint, w string")
    df, report = tables.scan_checked(spark, folder, "t", wanted)
    assert df.dtypes == [("id", "int"), ("v", "int"), ("n", "bigint"), ("w", "string")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[2]) == [(1, 2, 5, None), (None, None, 6, None), (None, None, 7, None)]
    assert sorted(map(tuple, report.collect())) == [
        ("id", "string", "int", "cast", 1), ("n", "bigint", "bigint", "same", 0), ("v", "double", "int", "cast", 1),
        ("w", None, "string", "missing", 0)]
    _, report = tables.scan_checked(spark, folder, "t", StructType.fromDDL("n bigint"))
    assert [r.column for r in report.filter("change = 'added'").collect()] == ["id", "v"]
    with pytest.raises(ValueError):
        tables.scan_checked(spark, folder, "t", StructType([StructField("w", StringType(), False)]))
