"""Provider payloads, saved pages, paths and addresses.

Payload documents are written by Spark from the given tables; the reference
SQL states what must come back straight from those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import DERIVED, Tables, trimmed
from staylens.operators import addresses, pages, payloads
from staylens.operators.registry import default_registries

DERIVED.update({
    # Addresses in the four formats, with the parts each should yield.
    "addresses": """
        select c_custkey as id,
            case c_custkey % 5 when 0 then c_custkey || ' Main St, ' || c_mktsegment || ', CO 80'
                    || c_custkey || ', USA'
                when 1 then '1 Kent St, North ' || c_mktsegment || ' NSW 2000, Australia'
                when 2 then 'Rua 1, Centro, ' || c_mktsegment || ' - SP, 01000-000, Brazil'
                when 3 then 'Gate 4, 00530 ' || c_mktsegment || ' City ( old ), Finland'
                else c_name end as address,
            case c_custkey % 5 when 0 then c_mktsegment when 1 then 'North ' || c_mktsegment
                when 2 then c_mktsegment when 3 then c_mktsegment || ' City ( old )' else '' end as city,
            case c_custkey % 5 when 0 then 'USA' when 1 then 'Australia' when 2 then 'Brazil'
                when 3 then 'Finland' else c_name end as country,
            case c_custkey % 5 when 0 then 'CO' when 1 then 'NSW' when 2 then 'SP' else '' end as state,
            case c_custkey % 5 when 0 then '80' || c_custkey else '' end as zip
        from {customer}""",
    "paths": """
        select id, city || ',' || country || '/' || case when id % 4 = 0 then 'ta_' || id else 'x' || id
                end || '_google_' || replace(name, '#', '_') || case when id % 7 = 0 then '.htm'
                else '.html' end as path_a,
            city || ',' || country || '/reviews-' || lower(replace(name, '#', '_')) || '-'
                || case when id % 5 = 0 then 'ta_1-' || id else 'x' || id end || '.html' as path_b
        from {hotels_b}""",
})


def document(*fields: Column, **named: Column) -> Column:
    return F.to_json(F.struct(*fields, *[c.alias(name) for name, c in named.items()]))


def entity(c: Column) -> Column:
    """Text as it stands in markup."""
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def hotel_list_payloads(t: Tables) -> DataFrame:
    """Pages with two hotels each; the second has no address."""
    address = F.struct(
        F.col("city").alias("cityName"), F.col("country").alias("countryCode"),
        F.array("street_address", F.lit("Floor 2")).alias("lines"),
        F.lit("0100").alias("postalCode"),
    )
    item = F.struct(
        F.lit("hotel").alias("type"), F.col("hotel_id").alias("hotelId"), F.col("name"),
        F.col("id").alias("dupeId"), F.lit("PAR").alias("iataCode"), address.alias("address"),
    )
    bare = F.struct(
        F.lit("hotel").alias("type"), F.concat("hotel_id", F.lit("b")).alias("hotelId"),
        F.col("name"), F.lit(None).cast("bigint").alias("dupeId"), F.lit(None).cast("string").alias("iataCode"),
        F.lit(None).cast(address_type()).alias("address"),
    )
    return t.hotels_b.select(document(data=F.array(item, bare)).alias("payload"))


def address_type() -> str:
    return "struct<cityName: string, countryCode: string, lines: array<string>, postalCode: string>"


@query("p1_parse_hotel_list", """
    select hotel_id, 'amadeus' as source, name, city, country, street_address || ', Floor 2' as
        street_address, '0100' as postal_code, '' as state_code, id as dupe_id, 'PAR' as iata_code
    from {hotels_b}
    union all select hotel_id || 'b', 'amadeus', name, '', '', '', '', '', 0, '' from {hotels_b}""")
def _(t: Tables):
    return payloads.parse_hotel_list(hotel_list_payloads(t)).select(
        "hotel_id", "source", "name", "city", "country", "street_address", "postal_code",
        "state_code", "dupe_id", "iata_code",
    )


@query("p2_parse_hotel_search", """
    select hotel_id, cast(id % 5 as int) as rating, 'd' || id as last_update from {hotels_b}
    where id % 4 <> 0""")
def _(t: Tables):
    item = F.struct(
        (F.col("id") % 5).cast("int").alias("rating"),
        F.concat(F.lit("d"), F.col("id")).alias("lastUpdate"),
    )
    other = F.struct(F.lit(9).alias("rating"), F.lit("x").alias("lastUpdate"))
    found = document(data=F.array(item, other))
    none = F.when(F.col("id") % 8 == 0, F.lit("{broken")).otherwise(F.lit('{"data":[]}'))
    rows = t.hotels_b.select("hotel_id", F.when(F.col("id") % 4 == 0, none).otherwise(found).alias("payload"))
    return payloads.parse_hotel_search(rows)


@query("p3_parse_hotel_ratings", """
    select hotel_id, cast(id % 50 as int) as number_of_reviews, cast(id % 9 as int) as number_of_ratings,
        cast(80 as int) as overall_rating, cast(id % 7 as int) as staff, cast(null as int) as catering
    from {hotels_b}""")
def _(t: Tables):
    item = F.struct(
        (F.col("id") % 50).alias("numberOfReviews"), (F.col("id") % 9).alias("numberOfRatings"),
        F.lit(80).alias("overallRating"),
        F.struct((F.col("id") % 7).alias("staff")).alias("sentiments"),
    )
    parsed = payloads.parse_hotel_ratings(
        t.hotels_b.select("hotel_id", document(data=F.array(item)).alias("payload"))
    )
    return parsed.select(
        "hotel_id", "number_of_reviews", "number_of_ratings", "overall_rating", "sentiments.staff",
        "sentiments.catering",
    )


def place_payloads(t: Tables) -> DataFrame:
    """Two pages per location; the second repeats the hotel under another name."""
    rows = t.hotels_a.join(
        t.addresses.select("id", "address"), "id"
    ).withColumn("page", F.explode(F.array(F.lit(0), F.lit(1))))
    item = F.struct(
        F.col("source_hotel_id").alias("id"),
        F.struct(F.concat_ws(" ", "name", "page").alias("text")).alias("displayName"),
        F.col("address").alias("formattedAddress"),
        F.struct(
            F.struct(
                (F.col("id") / 2).alias("latitude"), (-F.col("id") / 4).alias("longitude")
            ).alias("latLng")
        ).alias("location"),
        (F.col("id") % 5 + 0.5).cast("double").alias("rating"),
    )
    return rows.select(
        F.concat_ws(", ", "city", "country").alias("location"),
        (F.col("id") * 2 + F.col("page")).alias("pos"),
        document(places=F.array(item), nextPageToken=F.lit("t")).alias("payload"),
    )


@query("p4_parse_places", """
    select 'google_' || h.source_hotel_id as hotel_id, h.name || ' 0' as name, h.city, h.country,
        a.address as street_address, a.state as state_code, a.zip as postal_code,
        h.id / 2 as latitude, h.id / -4 as longitude, h.id % 5 + cast(0.5 as double) as google_rating
    from {hotels_a} h join {addresses} a on a.id = h.id""")
def _(t: Tables):
    return payloads.parse_places(place_payloads(t), "pos").select(
        "hotel_id", "name", "city", "country", "street_address", "state_code", "postal_code",
        "latitude", "longitude", "google_rating",
    )


def location_payloads(t: Tables) -> DataFrame:
    item = F.struct(
        F.col("id").cast("string").alias("location_id"), F.col("name"),
        F.struct(
            F.col("street_address").alias("street1"), F.lit("99").alias("postalcode")
        ).alias("address_obj"),
        F.when(F.col("id") % 3 == 0, F.lit("north")).otherwise(
            (F.col("id") / 8).cast("string")
        ).alias("latitude"),
        F.lit("-1.25").alias("longitude"), F.lit(4.5).alias("rating"), F.lit("1").alias("phone"),
    )
    return t.hotels_b.select(
        F.concat_ws(",", "city", F.concat(F.lit(" "), "country")).alias("location"),
        document(data=F.array(item)).alias("payload"),
    )


@query("p5_parse_location_search", """
    select 'ta_' || id as hotel_id, name, city, country, street_address, '99' as postal_code,
        case when id % 3 = 0 then cast(0 as double) else id / 8 end as latitude,
        cast(-1.25 as double) as longitude, cast(4.5 as double) as tripadvisor_rating, '' as email
    from {hotels_b}""")
def _(t: Tables):
    return payloads.parse_location_search(location_payloads(t)).select(
        "hotel_id", "name", "city", "country", "street_address", "postal_code", "latitude",
        "longitude", "tripadvisor_rating", "email",
    )


@query("p6_parse_business_search", """
    select 'yelp_' || id as hotel_id, 'yelp' as source, name, city, country,
        case when id % 2 = 0 then id / 4 else cast(0 as double) end as latitude, street_address,
        '77' as postal_code, '' as phone
    from {hotels_b}""")
def _(t: Tables):
    place = F.when(
        F.col("id") % 2 == 0,
        F.struct((F.col("id") / 4).alias("latitude"), F.lit(1.0).alias("longitude")),
    )
    item = F.struct(
        F.col("id").cast("string").alias("id"), F.col("name"),
        F.struct(
            F.col("street_address").alias("address1"), F.col("city"), F.col("country"),
            F.lit("77").alias("zip_code"),
        ).alias("location"),
        place.alias("coordinates"),
    )
    rows = t.hotels_b.select(document(businesses=F.array(item)).alias("payload"))
    return payloads.parse_business_search(rows).select(
        "hotel_id", "source", "name", "city", "country", "latitude", "street_address",
        "postal_code", "phone",
    )


def location_review_payloads(t: Tables) -> DataFrame:
    day = F.col("review_date")
    written = (
        F.when(F.col("id") % 4 == 0, F.lit("someday"))
        .when(F.col("id") % 4 == 1, F.lit("2 months ago"))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
    )
    item = F.struct(
        F.col("id").alias("id"), F.col("rating"), F.col("review_text").alias("text"),
        F.col("reviewer_name").alias("title"), written.alias("published_date"),
        F.struct(
            F.lit("me").alias("username"),
            F.struct(F.col("reviewer_location").alias("name")).alias("user_location"),
        ).alias("user"),
        (F.col("id") % 6).alias("helpful_votes"),
    )
    return t.reviews.select("hotel_id", document(data=F.array(item)).alias("payload"))


@query("p7_parse_reviews_a", """
    select hotel_id, sha256(review_text) as source_review_id,
        reviewer_name || chr(10) || review_text as review_text, rating,
        case when id % 4 = 1 then '2024-04-15' else strftime(review_date, '%Y-%m-%d') end as review_date,
        reviewer_location, cast(id % 6 as int) as helpful_count
    from {reviews} where id % 4 <> 0""")
def _(t: Tables):
    as_of = F.lit("2024-06-15 08:00:00").cast("timestamp")
    parsed = payloads.parse_reviews_a(location_review_payloads(t), as_of)
    return parsed.select(
        "hotel_id", "source_review_id", "review_text", "rating",
        F.date_format("review_date", "yyyy-MM-dd").alias("review_date"), "reviewer_location",
        "helpful_count",
    )


def place_review_payloads(t: Tables) -> DataFrame:
    def item(text: Column, when: Column) -> Column:
        return F.struct(
            F.struct(
                F.col("reviewer_name").alias("displayName"), F.lit("u").alias("uri")
            ).alias("authorAttribution"),
            F.col("rating"), F.struct(text.alias("text")).alias("text"),
            when.alias("publishTime"), F.col("google_maps_uri").alias("googleMapsUri"),
        )

    good = item(F.col("review_text"), F.date_format("review_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    bad = item(F.lit("never shown"), F.lit("yesterday"))
    photos = F.when(
        F.col("photo_name") != "",
        F.array(F.struct(F.col("photo_name").alias("name")), F.struct(F.lit("no").alias("name"))),
    )
    return t.reviews.select(
        "hotel_id", document(photos=photos, reviews=F.array(bad, good)).alias("payload")
    )


@query("p8_parse_reviews_b", """
    select hotel_id, sha256(review_text) as source_review_id, reviewer_name, 'u' as reviewer_location,
        rating, review_text, strftime(review_date, '%Y-%m-%d') as review_date, true as verified,
        google_maps_uri, photo_name from {reviews}""")
def _(t: Tables):
    return payloads.parse_reviews_b(place_review_payloads(t)).select(
        "hotel_id", "source_review_id", "reviewer_name", "reviewer_location", "rating",
        "review_text", F.date_format("review_date", "yyyy-MM-dd").alias("review_date"), "verified",
        "google_maps_uri", "photo_name",
    )


def card_pages(t: Tables) -> DataFrame:
    """A card per document, and an empty card that must be dropped."""
    card = F.concat(
        F.lit('<html><body><p>ad<p>ad<div data-test-target="HR_CC_CARD"><br><div class="x _a"><a><span>'
              "<span>"), entity(F.col("source")),
        F.lit('</span></span></a></div><div class="ZRBpD P _c"><div><span><a><span>'),
        entity(F.col("lang")),
        F.lit('</span></a></span></div></div><div class="_c"><div class="fIrGe _T bgMZj"><div><span>'
              "<div><span>"), entity(F.col("text")),
        F.lit('</span></div></span></div></div></div></div><div data-test-target="HR_CC_CARD">'
              "</div></body></html>"),
    )
    return t.documents.select(F.col("doc_id").alias("page_id"), card.alias("html"))


@query("p9_extract_cards", f"""
    select doc_id as page_id, cast(0 as int) as pos, source as title, lang as name,
        {trimmed('text')} as body from {{documents}}""")
def _(t: Tables):
    return pages.extract_cards(card_pages(t), "page_id")


@query("p10_extract_list_reviews", f"""
    select doc_id as page_id, cast(0 as int) as pos,
        case when doc_id % 2 = 0 then source else '' end as name, {trimmed('text')} as body,
        case when doc_id % 3 = 0 then 0.0 else cast(1 + doc_id % 5 as double) end as rating
    from {{documents}}""")
def _(t: Tables):
    stars = F.concat(
        F.lit('<div role="img" aria-label="'), (1 + F.col("doc_id") % 5).cast("string"),
        F.lit(' star rating"></div>'),
    )
    named = F.concat(
        F.lit('<div class="y-css-9vtc3g"><div class="y-css-8x4us"><div>'), entity(F.col("source")),
        F.lit("</div></div></div>"),
    )
    body = F.concat(
        F.lit('<div class="y-css-mhg9c5"><div>a</div><div>b</div><div><p>'), entity(F.col("text")),
        F.lit("</p></div></div>"),
    )
    loose = F.concat(F.lit("<p>"), entity(F.col("text")), F.lit("</p>"))
    item = F.concat(
        F.when(F.col("doc_id") % 2 == 0, named).otherwise(""),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(stars),
        F.when(F.col("doc_id") % 4 == 0, loose).otherwise(body),
    )
    html = F.concat(
        F.lit('<div id="reviews"><section><div class="y-css-mhg9c5"><ul><li>'), item,
        F.lit("<li>  </li></ul></div></section></div>"),
    )
    listed = t.documents.select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return pages.extract_list_reviews(listed, "page_id")


@query("p9_extract_page_articles")
def _(t: Tables):
    shape = {
        "card": [("article", {})], "title": [("h1", {})], "name": [("b", {})], "body": [("p", {})],
    }
    return pages.extract_cards(t.pages, "page_id", shape)


@query("p11_extract_hotel_links", """
    select c_custkey as page_id, cast(c_custkey as string) as source_hotel_id, c_name as name,
        case when c_custkey % 2 = 0 then 'https://www.tripadvisor.com' else 'http://x' end
            || '/Hotel_Review-g1-d' || c_custkey || '-Reviews.html' as url
    from {customer} where c_custkey % 5 <> 0""")
def _(t: Tables):
    key = F.col("c_custkey").cast("string")
    host = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("http://x")
    heading = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("<h3> <b>"), "c_name", F.lit("</b></h3>")))
    html = F.concat(
        F.lit('<ul><li class="ad"><a href="/Hotel_Review-g1-d9-x"><h3>no</h3></a></li>'
              '<li class="a stFPg"><a href="'), host, F.lit("/Hotel_Review-g1-d"), key,
        F.lit('-Reviews.html">'), F.coalesce(heading, F.lit("")), F.lit("</a></li></ul>"),
    )
    return pages.extract_hotel_links(
        t.customer.select(F.col("c_custkey").alias("page_id"), html.alias("html")), "page_id"
    )


@query("p12_extract_text", f"""
    with parts as (select page_id, list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1),
            lambda x: {trimmed("regexp_replace(x, '(?s)<[^>]*>', '', 'g')")}) as texts from {{pages}})
    select page_id, array_to_string(list_filter(texts, lambda x: x <> ''), chr(10)) as review_text
    from parts where len(list_filter(texts, lambda x: x <> '')) > 0""")
def _(t: Tables):
    return pages.extract_text(t.pages, "page_id")


@query("p13_parse_path_a", """
    select path_a as path, case when id % 4 = 0 then 'ta' else 'x' || id end as hotel_id,
        case when id % 4 = 0 then cast(id as string) else 'google' end as source,
        case when id % 4 = 0 then 'google ' else '' end
            || replace(replace(path_name, '#', ' '), '_', ' ') as name, city, country
    from (select p.*, h.name as path_name, h.city, h.country from {paths} p
        join {hotels_b} h on h.id = p.id) where id % 7 <> 0""")
def _(t: Tables):
    return pages.parse_path_a(t.paths.select(F.col("path_a").alias("path")))


@query("p14_parse_path_b", """
    select path_b as path, case when id % 5 = 0 then cast(id as string) else 'x' || id end as hotel_id
    from {paths}""")
def _(t: Tables):
    return pages.parse_path_b(t.paths.select(F.col("path_b").alias("path")))


@query("p15_parse_address", "select id, city, country, state, zip from {addresses}")
def _(t: Tables):
    parts = addresses.address_parts(F.col("address"))
    return t.addresses.select("id", parts.alias("a")).select("id", "a.*")


@query("p16_clean_city", """
    select id, case id % 5 when 0 then 'St. ' || upper(country) || '-x'
            when 1 then country || '-y' when 2 then country else city_part end as city
    from (select c_custkey as id, c_mktsegment as country, '-' as city_part from {customer})""")
def _(t: Tables):
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    written = (
        F.when(key % 5 == 0, F.concat(F.lit("St. "), F.upper(segment), F.lit("-x 75001")))
        .when(key % 5 == 1, F.concat(F.lit("00530  "), segment, F.lit("-y")))
        .when(key % 5 == 2, F.concat(segment, F.lit(" Paris")))
        .when(key % 5 == 3, F.lit("- Paris"))
        .otherwise(F.lit("-"))
    )
    return t.customer.select(key.alias("id"), addresses.clean_city(written).alias("city"))


@query("p17_parse_state", """
    select c_custkey as id, case c_custkey % 3 when 0 then c_mktsegment else '' end as state
    from {customer}""")
def _(t: Tables):
    written = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a, b,  "), "c_mktsegment", F.lit(" 1 , USA")))
        .when(F.col("c_custkey") % 3 == 1, F.lit("x,  ,USA"))
        .otherwise(F.lit("USA"))
    )
    return t.customer.select(
        F.col("c_custkey").alias("id"), addresses.state_token(written).alias("state")
    )


@query("p18_parse_photo", "select id, photo_name from {reviews}")
def _(t: Tables):
    photos = F.when(
        F.col("photo_name") != "", F.array(F.struct(F.col("photo_name").alias("name")))
    ).otherwise(F.array().cast("array<struct<name:string>>"))
    answer = F.when(F.col("id") % 8 == 0, F.lit("{}")).otherwise(document(photos=photos))
    return payloads.parse_photo(t.reviews.select("id", answer.alias("payload")))


def completions(t: Tables) -> DataFrame:
    """Answers of every conversation turn, fenced, bare, broken or empty."""
    item = F.struct(
        F.concat(F.lit("H"), "conv_id").alias("Hotel"), F.col("role").alias("City"),
        F.col("text").alias("Review"), (F.col("turn") + 0.5).cast("double").alias("Rating"),
        F.lit(0.25).alias("Distance"), F.lit("a").alias("Address"),
        F.when(F.col("turn") == 1, "").otherwise("places/1").alias("photo_name"),
        F.col("turn").alias("extra"),
    )
    body = F.to_json(F.array(item, item))
    # Some answers write the rating as a string.
    body = F.when(F.col("conv_id") % 3 == 0, F.regexp_replace(body, '"Rating":([0-9.]+)', '"Rating":"$1"')).otherwise(body)
    kind = F.col("turn") % 8
    content = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit(" ```"), body, F.lit("``` ")))
        .when(kind == 2, F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("x"), body))
              .when(F.col("conv_id") % 4 == 1, F.concat(body, F.lit(" trailing")))
              .when(F.col("conv_id") % 4 == 2, F.lit("[{'Hotel':'A'}]")).otherwise(F.lit('["A", 1]')))
        .when(kind == 3, F.lit("null"))
        .when(kind == 4, F.concat(body, F.lit("```")))
        .when(kind == 5, F.lit("  "))
        .otherwise(body)
    )
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), content.alias("content")
    )


@query("p19_parse_completions", """
    select conv_id * 1000 + turn as query_id, cast(pos as int) as pos, 'H' || conv_id as hotel,
        text as review, turn + cast(0.5 as double) as rating, turn as extra
    from {conversations}, (select unnest([0, 1]) as pos) p where turn % 8 not in (2, 3, 5)""")
def _(t: Tables):
    rows, _ = payloads.parse_completions(completions(t))
    return rows.select(
        "query_id", "pos", F.col("Hotel").alias("hotel"), F.col("Review").alias("review"),
        F.col("Rating").alias("rating"),
        F.get_json_object("item", "$.extra").cast("long").alias("extra"),
    )


@query("p19_parse_failures", """
    select conv_id * 1000 + turn as query_id, turn % 8 = 2 as parse_failed from {conversations}""")
def _(t: Tables):
    return payloads.parse_completions(completions(t))[1]


@query("x2_review_sources", """
    select 'google' as source, count(*) as parsed from {reviews}
    union all select 'saved_cards', count(*) from {documents}
    union all select 'tripadvisorAPI', count(*) from {reviews} where id % 4 <> 0""")
def _(t: Tables):
    sources = default_registries()["reviews"]
    as_of = F.lit("2024-06-15 08:00:00").cast("timestamp")
    jobs = {
        "google": lambda job: job(place_review_payloads(t)),
        "saved_cards": lambda job: job(card_pages(t), "page_id"),
        "tripadvisorAPI": lambda job: job(location_review_payloads(t), as_of),
    }
    counts = [
        run(sources.get(name)).agg(F.lit(name).alias("source"), F.count("*").alias("parsed"))
        for name, run in jobs.items()
    ]
    return counts[0].union(counts[1]).union(counts[2])


@query("x3_hotel_providers", """
    select 'amadeus' as source, 2 * count(*) as parsed from {hotels_b}
    union all select 'google', count(*) from {hotels_a} h join {addresses} a on a.id = h.id
    union all select 'tripadvisorAPI', count(*) from {hotels_b}""")
def _(t: Tables):
    providers = default_registries()["hotels"]
    jobs = {
        "amadeus": lambda job: job(hotel_list_payloads(t)),
        "google": lambda job: job(place_payloads(t), "pos"),
        "tripadvisorAPI": lambda job: job(location_payloads(t)),
    }
    counts = [
        jobs[name](providers.get(name)).agg(F.lit(name).alias("source"), F.count("*").alias("parsed"))
        for name in providers.enabled()
    ]
    return counts[0].union(counts[1]).union(counts[2])
