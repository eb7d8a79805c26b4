"""Keyed merges: two overlapping halves of the data as target and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import DERIVED, Tables
from staylens.catalog.relational import PHOTO_TARGETS
from staylens.operators import joins, merges
from staylens.operators.filters import non_empty
from staylens.operators.windows import keep_last

DERIVED.update({
    # Suppliers are stored; customers update them in pairs and add more.
    "hotel_target": """
        select 'h' || s_suppkey as hotel_id, 'google' as source, s_name as name,
            case when s_suppkey % 5 = 0 then '' else 'C' || s_nationkey end as city,
            s_acctbal as amadeus_rating, cast(0 as double) as google_rating, cast(null as double) as tripadvisor_rating,
            cast(1.5 as double) as booking_rating, s_suppkey % 2 = 0 as recommended, false as quality, true as quiet,
            '' as important_note, false as admin_flag, s_suppkey as dupe_id, '' as type,
            'p' || s_suppkey as phone, cast('2024' as string) as last_update,
            cast(0 as int) as number_of_reviews, cast(1 as int) as number_of_ratings,
            cast(0 as double) as overall_rating, '' as sentiments
        from {supplier}""",
    "hotel_updates": """
        select c_custkey as pos, 'h' || cast(floor(c_custkey / 2) as bigint) as hotel_id,
            case when c_custkey % 3 = 0 then 'tripadvisorAPI' else 'booking' end as source,
            case when c_custkey % 4 = 1 then '' else c_name end as name,
            case when c_custkey % 6 = 0 then '' else 'D' || c_nationkey end as city,
            case when c_custkey % 5 = 0 then 0.0 else c_acctbal end as amadeus_rating,
            c_custkey % 7 = 0 as recommended, c_custkey % 3 = 0 as quality, c_custkey % 2 = 0 as quiet,
            'note ' || c_custkey as important_note, c_custkey % 4 = 0 as admin_flag,
            c_custkey % 9 as dupe_id, c_mktsegment as type,
            case when c_custkey % 2 = 0 then 'q' || c_custkey else '' end as phone,
            cast('2025' as string) as last_update, cast(c_custkey % 50 as int) as number_of_reviews,
            cast(c_custkey % 30 as int) as number_of_ratings, cast(c_custkey % 100 as int) as overall_rating
        from {customer}""",
    "city_target": """
        select iata_code, name, country, airport_count, country_codes from {airport_city}""",
    "city_updates": """
        select pos, iata as iata_code, name, country, cast(pos % 9 as int) as airport_count,
            'K' || pos as country_codes from {airports} where length(iata) = 3""",
    "review_target": """
        select v.source, md5(a.review_text) as source_review_id, a.hotel_id, a.id
        from {reviews_a} a join {reviews} v on v.id = a.id""",
    "review_updates": """
        select source, case when id % 11 = 0 then ' ' else md5(review_text) end as source_review_id,
            hotel_id, id, review_text from {reviews}""",
    "photos": """
        select c_custkey as pos, s_name as hotel_name, cast(s_suppkey as string) as hotel_id,
            case when c_custkey % 3 = 0 then '' else 'new/' || c_custkey end as photo_name
        from {customer} join {supplier} on s_suppkey = cast(floor(c_custkey / 20) as bigint)""",
})


@query("m1_upsert_hotels", """
    with u as (select hotel_id, arg_max(name, pos) filter (where name <> '') as name,
            arg_max(city, pos) filter (where city <> '') as city,
            arg_max(amadeus_rating, pos) filter (where amadeus_rating <> 0) as amadeus_rating,
            bool_or(quality) as quality,
            arg_max(dupe_id, pos) filter (where dupe_id <> 0) as dupe_id,
            arg_max(phone, pos) filter (where phone <> '') as phone,
            arg_max(important_note, pos) as important_note from {hotel_updates} group by 1)
    select coalesce(t.hotel_id, u.hotel_id) as hotel_id, coalesce(u.name, t.name, '') as name,
        coalesce(u.city, t.city, '') as city,
        coalesce(u.amadeus_rating, t.amadeus_rating, 0.0) as amadeus_rating,
        coalesce(u.quality or t.quality, u.quality, t.quality) as quality,
        coalesce(u.dupe_id, t.dupe_id, 0) as dupe_id, coalesce(u.phone, t.phone, '') as phone,
        coalesce(u.important_note, t.important_note) as important_note
    from {hotel_target} t full join u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    merged = merges.upsert_hotels(t.hotel_target, t.hotel_updates, "pos")
    return merged.select(
        "hotel_id", "name", "city", "amadeus_rating", "quality", "dupe_id", "phone", "important_note"
    )


@query("m2_upsert_hotels_list", """
    with u as (select hotel_id, arg_max(source, pos) as source, arg_max(name, pos) as name,
            arg_max(city, pos) as city, arg_max(type, pos) as type, arg_max(dupe_id, pos) as dupe_id,
            arg_max(last_update, pos) as last_update, arg_min(phone, pos) as phone
        from {hotel_updates} group by 1)
    select coalesce(t.hotel_id, u.hotel_id) as hotel_id, coalesce(u.source, t.source) as source,
        coalesce(u.name, t.name) as name, coalesce(u.city, t.city) as city,
        coalesce(u.type, t.type) as type, coalesce(u.dupe_id, t.dupe_id) as dupe_id,
        coalesce(u.last_update, t.last_update) as last_update,
        case when t.hotel_id is null then u.phone else t.phone end as phone
    from {hotel_target} t full join u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    merged = merges.upsert_hotels_list(t.hotel_target, t.hotel_updates, "pos")
    return merged.select(
        "hotel_id", "source", "name", "city", "type", "dupe_id", "last_update", "phone"
    )


@query("m3_insert_reviews", """
    with keyed as (select source, case when trim(source_review_id) = '' then sha256(review_text)
            else source_review_id end as source_review_id, hotel_id, id from {review_updates}),
    fresh as (select * from keyed k where not exists (select 1 from {review_target} t
            where t.source = k.source and t.source_review_id = k.source_review_id)
        qualify row_number() over (partition by source, source_review_id order by id) = 1)
    select source, source_review_id, hotel_id, id from {review_target} union all select * from fresh""")
def _(t: Tables):
    updates = t.review_updates.withColumn("pos", F.col("id"))
    return merges.insert_reviews(t.review_target, updates, "pos")


@query("m4_upsert_cities", """
    with u as (select iata_code, arg_max(name, pos) as name, arg_max(country, pos) as country,
            arg_max(airport_count, pos) as airport_count, arg_max(country_codes, pos) as country_codes
        from {city_updates} group by 1)
    select coalesce(u.iata_code, t.iata_code) as iata_code, coalesce(u.name, t.name) as name,
        coalesce(u.country, t.country) as country,
        coalesce(u.airport_count, t.airport_count) as airport_count,
        coalesce(u.country_codes, t.country_codes) as country_codes
    from {city_target} t full join u on u.iata_code = t.iata_code""")
def _(t: Tables):
    return merges.upsert_cities(t.city_target, t.city_updates, "pos")


@query("m5_apply_ratings", """
    select t.hotel_id, t.amadeus_rating, t.google_rating,
        case when u.ta_pos is not null then u.ta else t.tripadvisor_rating end as tripadvisor_rating,
        case when u.booking_pos is not null then u.booking else t.booking_rating end as booking_rating,
        cast(null as double) as expedia_rating
    from {hotel_target} t left join (
        select hotel_id, arg_max(amadeus_rating, pos) filter (where source = 'tripadvisorAPI') as ta,
            max(pos) filter (where source = 'tripadvisorAPI') as ta_pos,
            arg_max(amadeus_rating, pos) filter (where source = 'booking') as booking,
            max(pos) filter (where source = 'booking') as booking_pos
        from {hotel_updates} group by 1) u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    ratings = t.hotel_updates.selectExpr("pos", "hotel_id", "source", "amadeus_rating as rating")
    merged = merges.apply_ratings(t.hotel_target, ratings, "pos")
    return merged.select(
        "hotel_id", "amadeus_rating", "google_rating", "tripadvisor_rating", "booking_rating",
        "expedia_rating",
    )


LAST = """(select * from {hotel_updates}
    qualify row_number() over (partition by hotel_id order by pos desc) = 1)"""


@query("m6_apply_recommendation", f"""
    select t.hotel_id, case when u.pos is null then t.recommended else u.recommended end as recommended,
        case when u.pos is null then t.quality else u.quality end as quality,
        case when u.pos is null then t.quiet else u.quiet end as quiet,
        case when u.pos is null then t.important_note else u.important_note end as important_note
    from {{hotel_target}} t left join {LAST} u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    merged = merges.apply_recommendation(t.hotel_target, t.hotel_updates, "pos")
    return merged.select("hotel_id", "recommended", "quality", "quiet", "important_note")


@query("m7_apply_admin_flag", f"""
    select t.hotel_id, t.name, coalesce(u.admin_flag, t.admin_flag) as admin_flag
    from {{hotel_target}} t left join {LAST} u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    merged = merges.apply_admin_flag(t.hotel_target, t.hotel_updates, "pos")
    return merged.select("hotel_id", "name", "admin_flag")


@query("m8_apply_search_rating", f"""
    select t.hotel_id, coalesce(cast(u.overall_rating as double), t.amadeus_rating) as amadeus_rating,
        coalesce(u.last_update, t.last_update) as last_update
    from {{hotel_target}} t left join {LAST} u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    found = t.hotel_updates.withColumn("rating", F.col("overall_rating"))
    merged = merges.apply_search_rating(t.hotel_target, found, "pos")
    return merged.select("hotel_id", "amadeus_rating", "last_update")


@query("m8_apply_provider_ratings", f"""
    select t.hotel_id, coalesce(u.number_of_reviews, t.number_of_reviews) as number_of_reviews,
        coalesce(u.number_of_ratings, t.number_of_ratings) as number_of_ratings,
        coalesce(cast(u.overall_rating as double), t.overall_rating) as overall_rating,
        case when u.pos is null then t.sentiments
            else '{{"staff":' || u.overall_rating || '}}' end as sentiments
    from {{hotel_target}} t left join {LAST} u on u.hotel_id = t.hotel_id""")
def _(t: Tables):
    staff = F.struct(F.col("overall_rating").alias("staff"))
    merged = merges.apply_provider_ratings(
        t.hotel_target, t.hotel_updates.withColumn("sentiments", staff), "pos"
    )
    return merged.select(
        "hotel_id", "number_of_reviews", "number_of_ratings", "overall_rating", "sentiments"
    )


NEWEST = """(select {key}, arg_max(photo_name, pos) as photo from {{photos}} group by 1)"""


@query("m9_refresh_photos_v1", f"""
    select t.id, t.hotel_name, coalesce(u.photo, t.photo_name) as photo_name from {{items}} t
    left join {NEWEST.format(key='hotel_name')} u on u.hotel_name = t.hotel_name""")
def _(t: Tables):
    merged = merges.refresh_photos_v1(t.items, t.photos, "pos", "hotel_name")
    return merged.select("id", "hotel_name", "photo_name")


@query("m9_refresh_photos_hotels", f"""
    select t.hotel_id, t.name, u.photo as photo_name from {{hotels_a}} t
    left join {NEWEST.format(key='hotel_name')} u on u.hotel_name = t.name""")
def _(t: Tables):
    merged = merges.refresh_photos_v1(t.hotels_a, t.photos, "pos", "name")
    return merged.select("hotel_id", "name", "photo_name")


@query("m10_refresh_photos_reviews", f"""
    select t.id, t.hotel_id, coalesce(u.photo, t.photo_name) as photo_name from {{reviews}} t
    left join {NEWEST.format(key='hotel_id')} u on u.hotel_id = t.hotel_id and u.photo <> ''""")
def _(t: Tables):
    reviews, _ = merges.refresh_photos_v2(t.reviews, t.items, t.photos, "pos")
    return reviews.select("id", "hotel_id", "photo_name")


@query("m10_refresh_photos_items", f"""
    select t.id, t.hotel_name, coalesce(u.photo, t.photo_name) as photo_name from {{items}} t
    left join {NEWEST.format(key='hotel_name')} u on u.hotel_name = t.hotel_name and u.photo <> ''""")
def _(t: Tables):
    _, items = merges.refresh_photos_v2(t.reviews, t.items, t.photos, "pos")
    return items.select("id", "hotel_name", "photo_name")


@query("m10_refresh_targets", f"""
    with targets as ({PHOTO_TARGETS})
    select t.hotel_name, t.hotel_id, t.photo_name as old_photo, u.photo as new_photo from targets t
    join {NEWEST.format(key='hotel_name')} u on u.hotel_name = t.hotel_name and u.photo <> ''""")
def _(t: Tables):
    targets = joins.photo_targets_v2(t.items, t.hotels_a, t.reviews)
    newest = keep_last(t.photos, ["hotel_name"], ["pos"]).filter(non_empty("photo_name"))
    return targets.withColumnRenamed("photo_name", "old_photo").join(
        newest.select("hotel_name", F.col("photo_name").alias("new_photo")), "hotel_name"
    )
