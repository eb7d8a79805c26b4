"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import Tables, hashed, trimmed
from staylens.functions import dates, text

AS_OF = "2024-03-31 10:30:00"


@query("c1_norm_key", f"""
    select city_source, city, {trimmed('lower(city)')} as city_key from {{dim_cities}}""")
def _(t: Tables):
    return t.dim_cities.select("city_source", "city", text.norm_key(F.col("city")).alias("city_key"))


@query("c2_text_hash", f"select doc_id, {hashed('text')} as text_hash from {{documents}}")
def _(t: Tables):
    return t.documents.select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query("c3_first_part", """
    select id, nullif(regexp_extract(reviewer_location, '^[^,]+'), '') as city from {reviews}""")
def _(t: Tables):
    return t.reviews.select("id", text.first_part(F.col("reviewer_location")).alias("city"))


@query("c4_last_part", """
    select id, case when reviewer_location like '%, %' then split_part(reviewer_location, ', ', 2) end
        as country from {reviews}""")
def _(t: Tables):
    return t.reviews.select("id", text.last_part(F.col("reviewer_location")).alias("country"))


@query("c5_first_non_blank", f"""
    select query_id, coalesce(nullif({trimmed('citycountry')}, ''), nullif({trimmed('continent')}, ''),
        '') as place from {{forms}}""")
def _(t: Tables):
    place = text.first_non_blank(F.col("citycountry"), F.col("continent"))
    return t.forms.select("query_id", place.alias("place"))


@query("c6_place_label", """
    select source_hotel_id, city || ', ' || country as place from {all_hotels}""")
def _(t: Tables):
    place = text.place_label(F.col("city"), F.col("country"))
    return t.all_hotels.select("source_hotel_id", place.alias("place"))


@query("c7_sha_id", """
    select doc_id, sha256(text) as text_id, sha256(text || source) as text_name_id
    from {documents}""")
def _(t: Tables):
    return t.documents.select(
        "doc_id", text.sha_id(F.col("text")).alias("text_id"),
        text.sha_id(F.col("text"), F.col("source")).alias("text_name_id"),
    )


@query("c8_prefixed_id", """
    select c_custkey, 'google_' || c_custkey as google, 'ta_' || c_custkey as ta,
        'yelp_' || c_custkey as yelp from {customer}""")
def _(t: Tables):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey", *[text.prefixed_id(p, key).alias(p) for p in ("google", "ta", "yelp")]
    )


@query("c9_titled_text", """
    select id, coalesce(reviewer_location, '') || chr(10) || review_text as body from {reviews}""")
def _(t: Tables):
    body = text.titled_text(F.col("reviewer_location"), F.col("review_text"))
    return t.reviews.select("id", body.alias("body"))


@query("c10_lenient_numbers", """
    select event_id, case when event_id % 5 <> 0 then cast(value as double) end as number,
        case when event_id % 5 <> 0 then cast(user_id as bigint) end as whole from {events}""")
def _(t: Tables):
    spoiled = F.when(F.col("event_id") % 5 == 0, F.lit("n/a"))
    number = spoiled.otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    whole = spoiled.otherwise(F.concat(F.lit("+"), F.col("user_id").cast("string")))
    return t.events.select(
        "event_id", text.parse_float(number).alias("number"), text.parse_int(whole).alias("whole")
    )


@query("c11_absolute_date", """
    select id, case id % 7 when 6 then null when 0 then strftime(review_date, '%Y-%m-%d 12:30:15')
        when 1 then strftime(review_date, '%Y-%m-%d 12:30:15')
        when 4 then strftime(review_date, '%Y-%m-%d 12:30:15')
        else strftime(review_date, '%Y-%m-%d 00:00:00') end as parsed from {reviews}""")
def _(t: Tables):
    kind, day = F.col("id") % 7, F.col("review_date")
    written = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd'T12:30:15Z'"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd'T14:30:15.000+02:00'"))
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(day, "MMM d, yyyy"))
        .when(kind == 4, F.date_format(day, "yyyy-MM-dd 12:30:15"))
        .when(kind == 5, F.date_format(day, "MMM d yyyy"))
        .otherwise(F.date_format(day, "'the' d MMMM"))
    )
    parsed = dates.absolute_date(F.concat(F.lit(" "), written))
    return t.reviews.select("id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("c12_relative_date", f"""
    with asked as (select id, cast(id % 40 as int) as n, id % 5 as unit,
        timestamp '{AS_OF}' as as_of from {{reviews}})
    select id, strftime(case unit when 0 then as_of - to_days(n) when 1 then as_of - to_days(7 * n)
        when 2 then date_trunc('month', as_of) - to_months(n) + (as_of - date_trunc('month', as_of))
        when 3 then date_trunc('month', as_of) - to_months(12 * n)
            + (as_of - date_trunc('month', as_of)) end, '%Y-%m-%d %H:%M:%S') as parsed
    from asked""")
def _(t: Tables):
    unit = F.col("id") % 5
    word = (
        F.when(unit == 0, "days").when(unit == 1, "Weeks").when(unit == 2, "month")
        .when(unit == 3, "YEARS").otherwise("moments")
    )
    written = F.concat_ws(" ", (F.col("id") % 40).cast("string"), word, F.lit("ago"))
    parsed = dates.relative_date(written, F.lit(AS_OF).cast("timestamp"))
    return t.reviews.select("id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("c13_rfc3339", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as parsed from {events}
    where event_id % 6 <> 0""")
def _(t: Tables):
    fraction = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    written = F.when(F.col("event_id") % 6 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(fraction)
    parsed = t.events.select("event_id", dates.rfc3339(written).alias("at")).filter("at is not null")
    return parsed.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query("c14_star_rating", """
    select id, case when id % 3 = 0 then 0.0 else rating end as stars from {reviews}""")
def _(t: Tables):
    n = F.col("rating").cast("int").cast("string")
    label = F.when(F.col("id") % 3 == 0, F.lit("unrated")).otherwise(
        F.concat(n, F.lit(" star rating"))
    )
    return t.reviews.select("id", text.star_rating(label).alias("stars"))


@query("c15_page_links", """
    select c_custkey, case when c_custkey % 4 <> 0 then 'https://www.yelp.com/biz/c-' || c_custkey end
        as biz_link, case when c_custkey % 3 <> 0 then cast(c_custkey as string) end as hotel_id
    from {customer}""")
def _(t: Tables):
    key = F.col("c_custkey").cast("string")
    biz = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("/biz/c-"), key)).otherwise("/ad/1")
    page = F.concat(F.lit('<a href="/ad">x</a><a href="'), biz, F.lit('">y</a>'))
    href = F.concat(
        F.lit("/Hotel_Review-g1-"), F.when(F.col("c_custkey") % 3 != 0, "d").otherwise("x"), key,
        F.lit("-Reviews.html"),
    )
    return t.customer.select(
        "c_custkey", text.first_biz_link(page).alias("biz_link"),
        text.list_hotel_id(href).alias("hotel_id"),
    )


@query("c16_file_slug", """
    select p_partkey, regexp_replace(replace(trim(lower(p_name || ' & ' || p_brand)), ' ', '_'),
        '[^a-z0-9_]', '', 'g') as slug from {part}""")
def _(t: Tables):
    name = F.concat(F.lit(" "), "p_name", F.lit(" & "), "p_brand", F.lit(" "))
    return t.part.select("p_partkey", text.file_slug(name).alias("slug"))


@query("c17_json_cast_size", """
    select cast(vec_id as string) as id, cast(len(embedding) as int) as n,
        '{"label":' || label || '}' as meta from {embeddings}""")
def _(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("id"), F.size("embedding").alias("n"),
        F.to_json(F.struct("label")).alias("meta"),
    )


@query("c18_fixed3", """
    select event_id, printf('%.3f', value * 1.0) as shown,
        case when value = floor(value) then cast(cast(value as bigint) as string)
            else cast(value as string) end as plain from {events}""")
def _(t: Tables):
    return t.events.select(
        "event_id", text.fixed3(F.col("value")).alias("shown"),
        text.plain_number(F.col("value")).alias("plain"),
    )


@query("c19_word_budget", """
    select p_partkey, (p_partkey * 4) // 5 > 512 as over from {part}""")
def _(t: Tables):
    return t.part.select("p_partkey", text.word_budget_exceeded(F.col("p_partkey"), 512).alias("over"))
