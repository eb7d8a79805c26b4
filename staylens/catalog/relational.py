"""Models, projections, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import Tables, hashed, trimmed
from staylens.functions.text import first_part, last_part, text_hash
from staylens.operators import aggregates as agg
from staylens.operators import filters, joins, sets, windows
from staylens.plans import models
from staylens.schemas import table



def key(x: str) -> str:
    return trimmed(f"lower({x})")


# --- models -----------------------------------------------------------------


@query("q1_all_hotels", "select * from {all_hotels}")
def _(t: Tables):
    return t.all_hotels


ALL_REVIEWS = """
    select id, hotel_id, source_review_id, insert_id, review_text, reviewer_name,
        reviewer_location, rating, cast(cast(review_date as date) as string) as review_date,
        google_maps_uri, photo_name, table_source{hash} from {{{table}}}"""


def dated(df):
    return df.withColumn("review_date", F.col("review_date").cast("date").cast("string"))


@query("q2_all_reviews", ALL_REVIEWS.format(hash=", review_text_hash", table="all_reviews"))
def _(t: Tables):
    return dated(t.all_reviews)


@query("q3_dim_cities", "select * from {dim_cities}")
def _(t: Tables):
    return t.dim_cities


CITY_COVERAGE = f"""
    with review_stats as (
        select coalesce(h.city, nullif(regexp_extract(r.reviewer_location, '^[^,]+'), '')) as city,
            count(*) as review_count, count(distinct r.hotel_id) as unique_hotels
        from {{all_reviews}} r left join {{all_hotels}} h on h.source_hotel_id = r.hotel_id
        group by 1),
    hotel_stats as (
        select city, count(distinct source_hotel_id) as hotel_count from {{all_hotels}} group by 1)
    select cb.city, cb.country, cb.continent,
        coalesce(r.review_count, 0) as review_count, coalesce(h.hotel_count, 0) as hotel_count,
        coalesce(r.review_count, 0) = 0 as zero_reviews,
        coalesce(r.review_count, 0) < 50 as low_reviews,
        coalesce(h.hotel_count, 0) = 0 as zero_hotels,
        coalesce(h.hotel_count, 0) < 50 as low_hotels
    from {{dim_cities}} cb
    left join review_stats r on {key('cb.city')} = {key('r.city')}
    left join hotel_stats h on {key('cb.city')} = {key('h.city')}"""


@query("q4_city_coverage", CITY_COVERAGE)
def _(t: Tables):
    return models.city_coverage(t.dim_cities, t.all_reviews, t.all_hotels)


@query("q5_city_hotel_counts", f"""
    select coalesce(h.city, c.city) as city, coalesce(h.country, c.country) as country, c.continent,
        count(distinct h.source_hotel_id) as hotel_count,
        count(distinct r.hotel_id) as review_linked_hotel_count
    from {{dim_cities}} c left join {{all_hotels}} h on {key('c.city')} = {key('h.city')}
    left join {{all_reviews}} r on h.source_hotel_id = r.hotel_id
    group by 1, 2, 3""")
def _(t: Tables):
    return models.city_hotel_counts(t.dim_cities, t.all_reviews, t.all_hotels)


@query("q6_city_review_counts", f"""
    with mapped as (
        select r.hotel_id,
            coalesce(h.city, nullif(regexp_extract(r.reviewer_location, '^[^,]+'), '')) as city,
            coalesce(h.country, nullif(regexp_extract(r.reviewer_location, ', ([^,]+)\\z', 1), ''))
                as country
        from {{all_reviews}} r left join {{all_hotels}} h on h.source_hotel_id = r.hotel_id)
    select c.city, c.country, d.continent, count(*) as review_count,
        count(distinct c.hotel_id) as unique_hotels, count(*) < 50 as is_low_review_city
    from mapped c left join {{dim_cities}} d on {key('d.city')} = {key('c.city')}
    group by 1, 2, 3""")
def _(t: Tables):
    return models.city_review_counts(t.dim_cities, t.all_reviews, t.all_hotels)


@query("q7_missing_reviews", f"""
    select r.id, r.hotel_id, r.source_review_id, r.insert_id, r.review_text, r.reviewer_name,
        r.rating, cast(cast(r.review_date as date) as string) as review_date, r.google_maps_uri,
        r.photo_name, r.table_source, h.hotel_name as hotel_hotel_name, h.street_address,
        h.city as hotel_city, h.country as hotel_country, c.city, c.country as city_country,
        c.continent, 'TRULY_MISSING' as status
    from {{all_reviews}} r left join {{all_hotels}} h on h.source_hotel_id = r.hotel_id
    left join {{dim_cities}} c on {key('c.city')} = {key('coalesce(h.city, r.reviewer_location)')}
    where not exists (select 1 from {{embedded}} e where e.review_text_hash = r.review_text_hash)""")
def _(t: Tables):
    return dated(
        models.missing_reviews(
            t.all_reviews, t.all_hotels, t.dim_cities, t.embedded_a, t.embedded_b
        )
    )


# --- projections and predicates ---------------------------------------------


@query("f1_with_provenance", """
    select source_hotel_id, name as hotel_name, street_address, city, country, source,
        'bigHotels' as table_source from {hotels_a}""")
def _(t: Tables):
    return filters.with_provenance(t.hotels_a, "bigHotels")


@query("f2_align", """
    select id, hotel_id, cast(null as string) as source_review_id, review_text,
        cast(null as double) as rating from {reviews_b}
    union all select id, hotel_id, null, review_text, null from {reviews_c}
    union all select id, hotel_id, source_review_id, review_text, rating from {reviews_a}
    union all select id, hotel_id, source_review_id, review_text, rating from {reviews_d}""")
def _(t: Tables):
    shape = table("id long, hotel_id string, source_review_id string, review_text string, rating double")
    a, b, c, d = (filters.align(arm, shape) for arm in (t.reviews_a, t.reviews_b, t.reviews_c, t.reviews_d))
    return b.union(c).union(a).union(d)


@query("f3_non_null_text", """
    select id, reviewer_location from {reviews} where reviewer_location is not null""")
def _(t: Tables):
    return filters.non_null_text(t.reviews, "reviewer_location").select("id", "reviewer_location")


@query("f4_hotels_after", """
    select hotel_id, name, city from {hotels_b}
    where source = 'tripadvisorAPI' and hotel_id > 'ta_633460'""")
def _(t: Tables):
    return filters.hotels_after(t.hotels_b, "tripadvisorAPI").select("hotel_id", "name", "city")


@query("f5_hotel_by_key", "select hotel_id, name from {hotels_b} where hotel_id = 'ta_7'")
def _(t: Tables):
    return filters.hotel_by_key(t.hotels_b, "ta_7").select("hotel_id", "name")


@query("f6_hotels_in_city", """
    select hotel_id, name, city, country from {hotels_b}
    where city = 'NATION_4' and country = (select country from {big_city} where name = 'NATION_4')""")
def _(t: Tables):
    place = t.big_city.filter("name = 'NATION_4'").select("country").scalar()
    return filters.hotels_in_city(t.hotels_b, "NATION_4", place)


@query("f7_hotels_in_continents", """
    select h.hotel_id, h.city, h.country, c.continent from {hotels_b} h
    left join {big_city} c on h.city = c.name and h.country = c.country
    where c.continent in ('ASIA', 'EUROPE')""")
def _(t: Tables):
    found = joins.hotels_in_continents(t.hotels_b, t.big_city, ["ASIA", "EUROPE"])
    return found.select("hotel_id", "city", "country", "continent")


@query("f8_by_ids", """
    select id, hotel_name, city from {items} where id in (
        select try_cast(x as bigint) from (
            select case when label = 3 then 'x' || vec_id else cast(vec_id as string) end as x
            from {embeddings}) where try_cast(x as bigint) is not null)""")
def _(t: Tables):
    text = F.when(F.col("label") == 3, F.concat(F.lit("x"), "vec_id")).otherwise(
        F.col("vec_id").cast("string")
    )
    return joins.by_ids(t.items, t.embeddings.select(text.alias("id"))).select(
        "id", "hotel_name", "city"
    )


@query("f9_non_empty", """
    select id, photo_name from {reviews} where photo_name is not null and photo_name <> ''
    and reviewer_location is not null and reviewer_location <> ''""")
def _(t: Tables):
    wanted = filters.non_empty("photo_name", "reviewer_location")
    return t.reviews.filter(wanted).select("id", "photo_name")


@query("f10_review_texts", f"""
    select photo_name as review_text from {{reviews}} where length({trimmed('photo_name')}) > 0""")
def _(t: Tables):
    return filters.review_texts(t.reviews.select(F.col("photo_name").alias("review_text")))


@query("f10_review_texts_of_hotel", f"""
    select review_text from {{reviews}} where hotel_id = '3' and length({trimmed('review_text')}) > 0""")
def _(t: Tables):
    return filters.review_texts(t.reviews, "3")


@query("f10_visible_texts", f"""
    select md5(review_text) as text_key from {{reviews}} where length({trimmed('review_text')}) > 0""")
def _(t: Tables):
    return filters.review_texts(t.reviews).select(F.md5("review_text").alias("text_key"))


@query("f11_hotel_ids", "select hotel_id from {hotels_b}")
def _(t: Tables):
    return filters.hotel_ids(t.hotels_b)


@query("f12_coverage_flags", """
    with c as (select city, count(distinct source_hotel_id) as hotel_count from {all_hotels} group by 1)
    select b.name, 0 as review_count, coalesce(c.hotel_count, 0) as hotel_count,
        true as zero_reviews, true as low_reviews, coalesce(c.hotel_count, 0) = 0 as zero_hotels,
        coalesce(c.hotel_count, 0) < 50 as low_hotels
    from {cities} b left join c on c.city = b.name""")
def _(t: Tables):
    stocked = agg.hotel_stats(t.all_hotels).withColumnRenamed("city", "name")
    joined = t.cities.select("name").join(stocked, "name", "left")
    return filters.coverage_flags(joined.withColumn("review_count", F.lit(None).cast("int")))


@query("f15_valid_airports", """
    select pos, name, city, country, iata from {airports}
    where iata <> '' and iata <> '\\N' and length(iata) = 3 and city <> '' and type = 'airport'""")
def _(t: Tables):
    return filters.valid_airports(t.airports).select("pos", "name", "city", "country", "iata")


# --- joins ------------------------------------------------------------------


@query("j1_reviews_hotels", """
    select r.id, r.hotel_id, h.source_hotel_id, h.hotel_name, h.city
    from {reviews} r left join {all_hotels} h on h.source_hotel_id = r.hotel_id""")
def _(t: Tables):
    return joins.reviews_hotels(t.reviews.select("id", "hotel_id"), t.all_hotels).select(
        "id", "hotel_id", "source_hotel_id", "hotel_name", "city"
    )


@query("j2_join_norm", f"""
    select h.source_hotel_id, h.city, c.city_source, c.continent from {{all_hotels}} h
    left join {{dim_cities}} c on {key('c.city')} = {key('h.city')}""")
def _(t: Tables):
    joined = joins.join_norm(t.all_hotels, t.dim_cities, "city", "city", ["city_source", "continent"])
    return joined.select("source_hotel_id", "city", "city_source", "continent")


@query("j3_missing_reviews_base", f"""
    select r.id, r.table_source, h.hotel_name as hotel_hotel_name, h.city as hotel_city,
        c.city, c.country as city_country, c.continent
    from {{all_reviews}} r left join {{all_hotels}} h on h.source_hotel_id = r.hotel_id
    left join {{dim_cities}} c on {key('c.city')} = {key('coalesce(h.city, r.reviewer_location)')}""")
def _(t: Tables):
    return models.missing_reviews_base(t.all_reviews, t.all_hotels, t.dim_cities).select(
        "id", "table_source", "hotel_hotel_name", "hotel_city", "city", "city_country", "continent"
    )


@query("j4_anti_hash", """
    select r.id, r.review_text_hash from {all_reviews} r
    where not exists (select 1 from {embedded} e where e.review_text_hash = r.review_text_hash)""")
def _(t: Tables):
    return joins.anti_hash(t.all_reviews, t.embedded).select("id", "review_text_hash")


@query("j5_cities_without_hotels", """
    select c.name, c.country from {cities} c
    left join {hotels_b} h on c.name = h.city and c.country = h.country where h.id is null""")
def _(t: Tables):
    return joins.cities_without_hotels(t.cities, t.hotels_b)


@query("j6_hydrate", """
    select e.id, e.hotel_name, e.city, h.street_address from {items} e
    join {hotels_a} h on h.name = e.hotel_name""")
def _(t: Tables):
    return joins.hydrate(t.items, t.hotels_a).select("id", "hotel_name", "city", "street_address")


@query("j7_photo_targets_v1", """
    select distinct h.name as hotel_name, h.hotel_id from {items} e
    join {hotels_a} h on h.name = e.hotel_name where h.hotel_id is not null and h.hotel_id <> ''""")
def _(t: Tables):
    return joins.photo_targets_v1(t.items, t.hotels_a)


PHOTO_TARGETS = """
    select distinct h.name as hotel_name, r.hotel_id, r.photo_name from {items} e
    join {hotels_a} h on h.name = e.hotel_name join {reviews} r on h.source_hotel_id = r.hotel_id
    where r.hotel_id is not null and r.hotel_id <> '' and r.source = 'google'
        and r.photo_name = e.photo_name"""


@query("j8_photo_targets_v2", PHOTO_TARGETS)
def _(t: Tables):
    return joins.photo_targets_v2(t.items, t.hotels_a, t.reviews)


@query("j9_denormalise", """
    select r.source_review_id, r.review_text, r.rating, r.hotel_id, h.name as hotel_name,
        c.name as city_name
    from {reviews} r left join {hotels_a} h on r.hotel_id = h.source_hotel_id
    left join {cities} c on h.city = c.name and h.country = c.country""")
def _(t: Tables):
    return joins.denormalise(t.reviews, t.hotels_a, t.cities)


@query("j11_match_country", """
    with named as (select a.pos, a.country, c.name as country_name, c.iso2, c.codes,
            row_number() over (partition by a.pos order by
                (lower(a.country) = lower(c.name)) desc, length(c.name) desc, c.iso2) as rn
        from {airports} a join {countries} c on contains(lower(a.country), lower(c.name)))
    select a.pos, a.country, n.country_name, n.iso2, n.codes from {airports} a
    left join named n on n.pos = a.pos and n.rn = 1""")
def _(t: Tables):
    return joins.match_country(t.airports, t.countries).select(
        "pos", "country", "country_name", "iso2", "codes"
    )


@query("j12_pending", """
    select hotel_id, source from {hotels_b} h where not exists (
        select 1 from {reviews} r where 'ta_' || r.hotel_id = h.hotel_id and r.source = h.source)""")
def _(t: Tables):
    fetched = t.reviews.select(F.concat(F.lit("ta_"), "hotel_id").alias("hotel_id"), "source")
    return joins.pending(t.hotels_b, fetched).select("hotel_id", "source")


@query("j14_search_requests", """
    select p.prefix || ' ' || c.name || ', ' || c.country as text_query,
        c.name || ', ' || c.country as location, 20 as max_result_count, 3 as max_pages
    from {cities} c, (select unnest(['quiet hotels near', 'best hotels near', 'cheap hotels near',
        'quality hotels in']) as prefix) p""")
def _(t: Tables):
    return joins.search_requests(t.cities)


# --- aggregations -----------------------------------------------------------


@query("a1_review_stats", """
    select coalesce(h.city, nullif(regexp_extract(r.reviewer_location, '^[^,]+'), '')) as city,
        count(*) as review_count, count(distinct r.hotel_id) as unique_hotels
    from {reviews} r left join {all_hotels} h on h.source_hotel_id = r.hotel_id group by 1""")
def _(t: Tables):
    return agg.review_stats(t.reviews, t.all_hotels)


@query("a2_hotel_stats", """
    select city, count(distinct source_hotel_id) as hotel_count from {all_hotels} group by 1""")
def _(t: Tables):
    return agg.hotel_stats(t.all_hotels)


@query("a3_two_distinct_counts", """
    select coalesce(h.city, 'none') as city, coalesce(h.country, 'none') as country,
        count(distinct h.source_hotel_id) as hotel_count, count(distinct h.source) as source_count
    from {all_hotels} h group by 1, 2""")
def _(t: Tables):
    return t.all_hotels.groupBy(
        F.coalesce("city", F.lit("none")).alias("city"),
        F.coalesce("country", F.lit("none")).alias("country"),
    ).agg(
        F.count_distinct("source_hotel_id").alias("hotel_count"),
        F.count_distinct("source").alias("source_count"),
    )


@query("a4_low_review_flag", """
    select nullif(regexp_extract(reviewer_location, '^[^,]+'), '') as city,
        nullif(regexp_extract(reviewer_location, ', ([^,]+)\\z', 1), '') as country,
        count(*) as review_count, count(*) < 50 as is_low_review_city
    from {reviews} group by 1, 2""")
def _(t: Tables):
    place = F.col("reviewer_location")
    counted = t.reviews.groupBy(
        first_part(place).alias("city"), last_part(place).alias("country")
    ).agg(F.count("*").alias("review_count"))
    return agg.low_review_flag(counted)


@query("a5_distinct_locations", """
    select continent, array_to_string(list_sort(list(distinct city || ', ' || country)), '; ')
        as city_countries from {items}
    where continent <> '' and city <> '' and country <> '' group by 1""")
def _(t: Tables):
    found = agg.distinct_locations(t.items)
    return found.withColumn("city_countries", F.array_join("city_countries", "; "))


AIRPORT_CITIES = """
    with named as (select a.*, c.name as country_name, c.iso2, c.codes,
            row_number() over (partition by a.pos order by
                (lower(a.country) = lower(c.name)) desc, length(c.name) desc, c.iso2) as rn
        from {airports} a join {countries} c on contains(lower(a.country), lower(c.name))),
    airport_cities as (
        select arg_min(iata, pos) as iata_code, arg_min(city, pos) as name,
            country_name as country, cast(count(*) as int) as airport_count, codes as country_codes
        from named where rn = 1 group by country_name, codes, lower(city))
    """


@query("a6_airport_cities", AIRPORT_CITIES + "select * from airport_cities")
def _(t: Tables):
    return agg.airport_cities(joins.match_country(t.airports, t.countries))


AIRPORT_CODES = """
    with codes as (select city, country, iata, count(*) as n, min(pos) as pos from {airports}
        where iata <> '' and iata <> '\\N' and length(iata) = 3 and city <> '' and type = 'airport'
        group by 1, 2, 3),
    coded as (select city, country, cast(sum(n) as bigint) as airport_count,
        list(iata order by pos) as iatas from codes group by 1, 2)
    """


@query("a7_airport_city_codes", AIRPORT_CODES + """
    select city, country, airport_count, array_to_string(iatas, ' ') as iatas from coded""")
def _(t: Tables):
    coded = agg.airport_city_codes(filters.valid_airports(t.airports))
    return coded.withColumn("iatas", F.array_join("iatas", " "))


@query("a7_one_row_per_code", AIRPORT_CODES + """
    select unnest(iatas) as iata_code, city as name, country, airport_count from coded""")
def _(t: Tables):
    return agg.one_row_per_code(agg.airport_city_codes(filters.valid_airports(t.airports)))


@query("a8_saved_by_source", """
    select source, count(*) as saved from {all_hotels} group by rollup (source)""")
def _(t: Tables):
    return agg.saved_by_source(t.all_hotels)


@query("a9_result_stats", """
    select label as query_id, count(*) as result_count,
        coalesce(round(avg(case when label <> 4 then rating end), 1), 0.0) as mean_rating,
        count(distinct city) as city_count from {items} group by 1""")
def _(t: Tables):
    rated = t.items.select(
        F.col("label").alias("query_id"), F.when(F.col("label") != 4, F.col("rating")).alias("rating"),
        "city",
    )
    return agg.result_stats(rated, "query_id")


@query("a13_duplicate_reviews", f"""
    select source, {hashed('review_text')} as source_review_id, count(*) as copies from {{reviews}}
    group by 1, 2 having count(*) > 1""")
def _(t: Tables):
    keyed = t.reviews.select("source", text_hash(F.col("review_text")).alias("source_review_id"))
    return agg.duplicate_reviews(keyed)


@query("a14_low_hotel_cities", """
    select city, count(distinct source_hotel_id) as hotel_count,
        count(distinct source_hotel_id) < 10 as is_low_hotel_city from {hotels_a} group by 1""")
def _(t: Tables):
    return agg.low_hotel_cities(agg.hotel_stats(t.hotels_a))


@query("a15_refresh_audit", """
    with seen as (select hotel_id, photo_name,
            row_number() over (partition by hotel_id, photo_name <> '' order by id) as rn
        from {reviews} where source = 'google')
    select count(*) as read, count(*) filter (where photo_name <> '' and rn = 1) as matched,
        count(*) filter (where photo_name = '') as skipped_empty,
        count(*) filter (where photo_name <> '' and rn > 1) as skipped_duplicate from seen""")
def _(t: Tables):
    return agg.refresh_audit(t.reviews.filter("source = 'google'").select("hotel_id", "photo_name"))


# --- windows ----------------------------------------------------------------


@query("w1_dedupe_by_hash", """
    select id, table_source, hotel_id, review_text_hash from {all_reviews}""")
def _(t: Tables):
    return windows.dedupe_by_hash(t.union_reviews).select(
        "id", "table_source", "hotel_id", "review_text_hash"
    )


TOP = "airport_count desc, name, iata_code"


@query("w2_top_cities", AIRPORT_CITIES + f"""
    select * from airport_cities
    qualify row_number() over (partition by country order by {TOP}) <= 25""")
def _(t: Tables):
    return windows.top_cities(agg.airport_cities(joins.match_country(t.airports, t.countries)))


@query("w3_keep_first", """
    select hotel_id, id, reviewer_name from {reviews}
    qualify row_number() over (partition by hotel_id order by review_date, id) = 1""")
def _(t: Tables):
    return windows.keep_first(t.reviews, ["hotel_id"], ["review_date", "id"]).select(
        "hotel_id", "id", "reviewer_name"
    )


@query("w4_keep_last", """
    select hotel_id, id, reviewer_name from {reviews}
    qualify row_number() over (partition by hotel_id order by review_date desc, id desc) = 1""")
def _(t: Tables):
    return windows.keep_last(t.reviews, ["hotel_id"], ["review_date", "id"]).select(
        "hotel_id", "id", "reviewer_name"
    )


@query("w5_rank_hits", """
    select user_id as query_id, event_id as id, value as distance,
        cast(row_number() over (partition by user_id order by value desc, event_id) as int) as rank
    from {events}""")
def _(t: Tables):
    hits = t.events.selectExpr("user_id as query_id", "event_id as id", "value as distance")
    return windows.rank_hits(hits)


@query("w5_rank_nearest", """
    select user_id as query_id, event_id as id, value as distance,
        cast(row_number() over (partition by user_id order by value desc, event_id) as int) as rank
    from {events}
    qualify row_number() over (partition by user_id order by value desc, event_id) <= 10""")
def _(t: Tables):
    hits = t.events.selectExpr("user_id as query_id", "event_id as id", "value as distance")
    return windows.rank_hits(hits, 10)


# --- sorts and limits -------------------------------------------------------


@query("o1_order_by", "select source_no, id, hotel_id from {reviews} order by source_no, id")
def _(t: Tables):
    return t.reviews.select("source_no", "id", "hotel_id").orderBy("source_no", "id")


@query("o2_reviews_for_hotel", """
    select id, cast(cast(review_date as date) as string) as review_date,
        cast(cast(created_at as date) as string) as created_at from {reviews} where hotel_id = '3'""")
def _(t: Tables):
    found = windows.reviews_for_hotel(t.reviews, "3")
    return dated(found).select(
        "id", "review_date", F.col("created_at").cast("date").cast("string").alias("created_at")
    )


@query("o3_top10", AIRPORT_CITIES + f"select * from airport_cities order by {TOP} limit 10")
def _(t: Tables):
    return windows.top_n(agg.airport_cities(joins.match_country(t.airports, t.countries)), 10)


@query("o4_top1000", AIRPORT_CODES + """
    select city as name, country, airport_count, iatas[1] as iata_code from coded
    order by airport_count desc, name, iata_code limit 1000""")
def _(t: Tables):
    coded = agg.airport_city_codes(filters.valid_airports(t.airports))
    named = coded.select(
        F.col("city").alias("name"), "country", "airport_count", F.col("iatas")[0].alias("iata_code")
    )
    return windows.top_n(named, 1000)


@query("o5_slice", """
    select hotel_id, name from {hotels_b} order by hotel_id limit 2400 offset 537""")
def _(t: Tables):
    return windows.slice_rows(t.hotels_b, ["hotel_id"], 537, 2400).select("hotel_id", "name")


@query("o5_offset", "select hotel_id, name from {hotels_b} order by hotel_id offset 537")
def _(t: Tables):
    return windows.slice_rows(t.hotels_b, ["hotel_id"], 537).select("hotel_id", "name")


# --- set operations ---------------------------------------------------------


@query("u1_union_hotels", "select source_hotel_id, hotel_name, table_source from {all_hotels}")
def _(t: Tables):
    arms = {"bigHotels": t.hotels_a, "hotels": t.hotels_b, "hotels_old_amadeusdev": t.hotels_c}
    return sets.union_hotels(arms).select("source_hotel_id", "hotel_name", "table_source")


@query("u2_union_reviews", ALL_REVIEWS.format(hash="", table="union_reviews"))
def _(t: Tables):
    return dated(t.union_reviews)


@query("u3_union_cities", "select city, country, city_source from {dim_cities}")
def _(t: Tables):
    arms = {"bigCity": t.big_city, "cities": t.cities, "airportCity": t.airport_city}
    return sets.union_cities(arms).select("city", "country", "city_source")


@query("u4_embedded_hashes", "select review_text_hash from {embedded}")
def _(t: Tables):
    return sets.embedded_hashes(t.embedded_a, t.embedded_b)


@query("u5_distinct", "select distinct hotel_id, source, photo_name from {reviews}")
def _(t: Tables):
    return t.reviews.select("hotel_id", "source", "photo_name").distinct()
