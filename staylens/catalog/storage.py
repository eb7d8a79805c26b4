"""Readers and writers: what is written must be read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from staylens import schemas
from staylens.catalog.base import query
from staylens.catalog.extraction import document
from staylens.catalog.relational import dated
from staylens.catalog.tables import Tables
from staylens.session import shared_dir
from staylens.sources import files, sinks, tables


@query("s1_scan", "select * from {nation}")
def _(t: Tables):
    return tables.scan(t.spark, t.folder, "nation")


# Schemas that a later reader wants of three tables: casts, missing and added columns.
WANTED = {
    "documents": "doc_id string, text string, source int, n_chars int, license string",
    "events": "event_id bigint, ts string, user_id int, event_type string, value int",
    "supplier": "s_suppkey bigint, s_name int, s_nationkey string, s_acctbal double, s_phone string",
}


def checked(t: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    return tables.scan_checked(t.spark, t.folder, name, StructType.fromDDL(WANTED[name]))


@query("s1_scan_checked", """
    select cast(doc_id as varchar) as doc_id, md5(text) as text, try_cast(source as int) as source,
        cast(n_chars as int) as n_chars, cast(null as varchar) as license from {documents}""")
def _(t: Tables):
    return checked(t, "documents")[0].withColumn("text", F.md5("text"))


@query("s1_schema_report", """
    with lost as (select
            (select count(source) - count(try_cast(source as int)) from {documents}) as source,
            (select count(s_name) - count(try_cast(s_name as int)) from {supplier}) as s_name)
    select * from (values
        ('documents', 'doc_id', 'bigint', 'string', 'cast', 0), ('documents', 'text', 'string', 'string', 'same', 0),
        ('documents', 'source', 'string', 'int', 'cast', (select source from lost)),
        ('documents', 'n_chars', 'bigint', 'int', 'cast', 0),
        ('documents', 'license', null, 'string', 'missing', 0), ('documents', 'lang', 'string', null, 'added', 0),
        ('events', 'event_id', 'bigint', 'bigint', 'same', 0), ('events', 'ts', 'timestamp_ntz', 'string', 'cast', 0),
        ('events', 'user_id', 'bigint', 'int', 'cast', 0), ('events', 'event_type', 'string', 'string', 'same', 0),
        ('events', 'value', 'double', 'int', 'cast', 0), ('events', 'props', 'string', null, 'added', 0),
        ('supplier', 's_suppkey', 'bigint', 'bigint', 'same', 0),
        ('supplier', 's_name', 'string', 'int', 'cast', (select s_name from lost)),
        ('supplier', 's_nationkey', 'int', 'string', 'cast', 0),
        ('supplier', 's_acctbal', 'double', 'double', 'same', 0),
        ('supplier', 's_phone', null, 'string', 'missing', 0))
        v("table", "column", stored, wanted, change, lost)""")
def _(t: Tables):
    reports = [checked(t, name)[1].withColumn("table", F.lit(name)) for name in WANTED]
    return reduce(DataFrame.unionByName, reports)


@query("s2_by_id", "select c_custkey, c_name from {customer} where c_custkey = 42")
def _(t: Tables):
    return tables.by_id(t.customer, "42", "c_custkey").select("c_custkey", "c_name")


def write_lines(df: DataFrame, label: str) -> str:
    """One text line per row in a new folder."""
    folder = shared_dir(df.sparkSession, label)
    df.write.text(folder)
    return folder


def quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'))


@query("s3_read_airports", """
    select id, name || ', intl' as name, city, country, iata, '3' as altitude, type, 'OurAirports'
        as source from {airports} where pos % 10 <> 0""")
def _(t: Tables):
    full = F.concat_ws(
        ",", F.col("id"), F.concat(F.lit('"'), "name", F.lit(', intl"')), quoted("city"),
        F.concat(F.lit(" "), quoted("country")), quoted("iata"), F.lit('"ICAO"'), F.lit("1.5"),
        F.lit("2.5"), F.lit(" 3 "), F.lit("0"), F.lit('"E"'), F.lit('"Europe/Paris"'),
        quoted("type"), F.lit('"OurAirports"'),
    )
    line = F.when(F.col("pos") % 10 == 0, F.regexp_replace(full, ',"OurAirports"', "")).when(
        F.col("pos") % 10 == 1, F.concat(full, F.lit(",extra"))
    ).otherwise(full)
    folder = write_lines(t.airports.select(line.alias("value")), "airports")
    return files.read_airports(t.spark, folder).select(
        "id", "name", "city", "country", "iata", "altitude", "type", "source"
    )


@query("s4_read_countries", """
    select name || ', new' as name, iso2, codes from (select n_name as name,
        case when n_nationkey = 9 then 'KP' else 'C' || n_nationkey end as iso2,
        case when n_nationkey % 2 = 0 then 'C' || n_nationkey
            else 'C' || n_nationkey || ',X' || n_nationkey end as codes from {nation})
    where iso2 <> 'KP'""")
def _(t: Tables):
    key = F.col("n_nationkey").cast("string")
    code = F.when(F.col("n_nationkey") == 9, "KP").otherwise(F.concat(F.lit("C"), key))
    alt = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "C").otherwise("X"), key)
    version = F.explode(F.array(F.lit("old"), F.lit("new"))).alias("version")
    rows = t.nation.select("n_name", code.alias("iso2"), alt.alias("alt"), version)
    line = F.concat(
        F.lit('"'), "n_name", F.lit(", "), "version", F.lit('", '), "iso2", F.lit(","), "alt"
    )
    folder = write_lines(rows.select(line.alias("value")).coalesce(1), "countries")
    return files.read_countries(t.spark, folder)


@query("s5_read_city_files", """
    select name, ' ' || country as country, 'notdetected' as continent from {big_city}""")
def _(t: Tables):
    good = F.concat("name", F.lit(", "), "country")
    bad = F.concat("name", F.lit(","), "country", F.lit(",x"))
    lines = t.big_city.select(F.explode(F.array(good, bad)).alias("value"))
    return files.read_city_files(t.spark, write_lines(lines, "cities"))


@query("s6_saved_pages", "select page_id, url, length(html) as n from {pages}")
def _(t: Tables):
    # Saved pages are landed as a table; folders of page files are read by read_saved_pages.
    return tables.scan(t.spark, t.folder, "pages").select(
        "page_id", "url", F.length("html").cast("bigint").alias("n")
    )


@query("s7_export_reviews", """
    select hotel_id, review_text, reviewer_name, rating,
        split_part(reviewer_location, ', ', 1) as city, split_part(reviewer_location, ', ', 2) as country
    from {reviews}""")
def _(t: Tables):
    place = {c: F.split_part("reviewer_location", F.lit(", "), F.lit(i)) for i, c in ((1, "city"), (2, "country"))}
    return tables.export_reviews(t.reviews.withColumns(place))


@query("s8_read_payloads", """
    select c_custkey as id, case when c_custkey % 3 <> 0 then c_name end as name from {customer}""")
def _(t: Tables):
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    folder = write_lines(
        t.customer.select(document(id=F.col("c_custkey"), name=name).alias("value")), "payloads"
    )
    read = files.read_payloads(t.spark, folder, "struct<id: bigint, name: string>")
    return read.select("payload.id", "payload.name")


@query("k1_append", """
    select event_id, user_id from {events} union all select event_id, user_id from {events}""")
def _(t: Tables):
    path = shared_dir(t.spark, "append")
    rows = t.events.select("event_id", "user_id")
    sinks.append(rows, path, batch=5000)
    sinks.append(rows.filter("false"), path)
    sinks.append(rows, path)
    return t.spark.read.parquet(path)


@query("k2_create_if_absent", "select event_id, user_id from {events}")
def _(t: Tables):
    path = shared_dir(t.spark, "create")
    rows = t.events.select("event_id", "user_id")
    sinks.create_if_absent(t.spark, rows.schema, path)
    sinks.append(rows, path)
    sinks.create_if_absent(t.spark, rows.schema, path)
    return t.spark.read.parquet(path)


@query("k3_overwrite", """
    select cast(id as int) as id, hotel_id, rating from {reviews}""")
def _(t: Tables):
    path = shared_dir(t.spark, "overwrite")
    shape = schemas.table("id integer, hotel_id string, rating double")
    sinks.overwrite(t.reviews.filter("rating = 1"), path, shape)
    sinks.overwrite(t.reviews, path, shape)
    return t.spark.read.parquet(path)


@query("k4_stage_load_jsonl", "select id, hotel_id, review_text from {reviews} where id % 3 <> 0")
def _(t: Tables):
    path = shared_dir(t.spark, "stage")
    typed = F.when(F.col("id") % 3 == 0, F.lit("not a number")).otherwise(F.col("id").cast("string"))
    sinks.stage_jsonl(t.reviews.select(typed.alias("id"), "hotel_id", "review_text", "source"), path)
    numbers = t.spark.read.text(path).select(
        F.regexp_replace("value", r'"id":"(\d+)"', r'"id":$1').alias("value")
    )
    fixed = shared_dir(t.spark, "stage")
    numbers.write.option("compression", "gzip").text(fixed)
    return sinks.load_jsonl(t.spark, fixed, "id bigint, hotel_id string, review_text string")


@query("k5_export_embeddings", """
    select cast(id as string) as id, cast(len(embedding) as int) as n, '{"reviewer_name":"'
        || reviewer_name || '","rating":' || rating || ',"city":"' || city || '","country":"'
        || country || '"}' as rest_metadata from {items}""")
def _(t: Tables):
    path = shared_dir(t.spark, "export")
    exported = sinks.export_embeddings(t.items, ["reviewer_name", "rating", "city", "country"])
    sinks.stage_jsonl(exported, path)
    read = sinks.load_jsonl(t.spark, path, "id string, embedding array<float>, rest_metadata string")
    return read.select("id", F.size("embedding").alias("n"), "rest_metadata")


@query("k6_build_datapoints", """
    select cast(id as string) as datapoint_id, cast(len(embedding) as int) as n,
        'hotel_name=' || hotel_name || ' city=' || city || ' country=' || country || ' continent='
        || continent as restricts, rating, photo_name from {items}""")
def _(t: Tables):
    path = shared_dir(t.spark, "datapoints")
    points = sinks.build_datapoints(
        t.items, ["hotel_name", "city", "country", "continent"], ["rating"],
        ["review_text", "reviewer_name", "google_maps_uri", "photo_name"],
    )
    sinks.overwrite(points, path)
    pair = F.transform(
        "restricts", lambda r: F.concat(r["namespace"], F.lit("="), r["allow_list"][0])
    )
    return t.spark.read.parquet(path).select(
        "datapoint_id", F.size("feature_vector").alias("n"),
        F.array_join(pair, " ").alias("restricts"),
        F.col("numeric_restricts")[0]["value"].alias("rating"), "metadata.photo_name",
    )


@query("k7_upsert_vectors", """
    select vec_id as id, label * 100 as label from {embeddings} where label >= 5
    union all select vec_id, label from {embeddings} where label < 5
    union all select vec_id + 1000000, label * 100 from {embeddings} where label >= 5""")
def _(t: Tables):
    base = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    changed = base.filter("label >= 5")
    delta = changed.withColumn("label", F.lit(-1)).withColumn("pos", F.lit(1))
    last = changed.withColumn("label", F.col("label") * 100).withColumn("pos", F.lit(2))
    added = last.withColumn("id", F.col("id") + 1000000)
    merged = sinks.upsert_vectors(base, delta.unionByName(last).unionByName(added), "pos")
    return merged.select("id", "label")


@query("k8_materialise_table", "select hotel_id, name, city from {hotels_b}")
def _(t: Tables):
    name = f"staylens_{uuid.uuid4().hex}"
    sinks.materialise(t.hotels_b.select("hotel_id", "name", "city"), name, "table")
    return t.spark.table(name)


@query("k8_materialise", """
    select id, table_source, cast(cast(review_date as date) as string) as review_date
    from {all_reviews}""")
def _(t: Tables):
    sinks.materialise(t.all_reviews.drop("review_text"), "staylens_all_reviews")
    return dated(t.spark.table("staylens_all_reviews")).select("id", "table_source", "review_date")
