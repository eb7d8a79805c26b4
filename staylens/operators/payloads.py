"""Provider payloads (one JSON document per row) to hotel, rating and review rows.

Every job takes rows with a ``payload`` string and keeps Catalyst's pruned
JSON parsing: only the fields selected below are read from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from staylens import schemas
from staylens.functions.dates import review_date, rfc3339
from staylens.functions.text import parse_float, prefixed_id, sha_id, titled_text, trim_ws
from staylens.operators.addresses import address_parts
from staylens.operators.windows import keep_first

# Source names of the providers.
AMADEUS = "amadeus"
GOOGLE = "google"
TRIPADVISOR = "tripadvisorAPI"
YELP = "yelp"


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("_p", F.from_json("payload", schema))


def _items(df: DataFrame, schema: str, field: str) -> DataFrame:
    """One row per array item of a payload, with its position in the array."""
    kept = [c for c in df.columns if c != "payload"]
    return _parsed(df, schema).select(*kept, F.posexplode(f"_p.{field}").alias("_pos", "_i"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def parse_hotel_list(df: DataFrame) -> DataFrame:
    """Hotel-list pages to hotels; the address document gives city, lines and codes."""
    items = _items(df, schemas.HOTEL_LIST_PAYLOAD, "data").withColumn(
        "_a", F.from_json("_i.address", schemas.HOTEL_ADDRESS)
    )
    lines = F.array_join(F.coalesce("_a.lines", F.array().cast("array<string>")), ", ")
    return items.select(
        F.col("_i.hotelId").alias("hotel_id"),
        F.lit(AMADEUS).alias("source"),
        F.col("_i.hotelId").alias("source_hotel_id"),
        _text("_i.name").alias("name"),
        _text("_a.cityName").alias("city"),
        _text("_a.countryCode").alias("country"),
        lines.alias("street_address"),
        _text("_a.postalCode").alias("postal_code"),
        _text("_a.stateCode").alias("state_code"),
        _text("_i.type").alias("type"),
        F.coalesce("_i.dupeId", F.lit(0)).alias("dupe_id"),
        _text("_i.iataCode").alias("iata_code"),
        _text("_i.lastUpdate").alias("last_update"),
    )


def parse_hotel_search(df: DataFrame) -> DataFrame:
    """Rating and update time of the first hotel offered; empty answers give no row."""
    first = F.get("_p.data", F.lit(0))
    return (
        _parsed(df, schemas.HOTEL_SEARCH_PAYLOAD)
        .withColumn("_f", first)
        .filter(F.col("_f").isNotNull())
        .select(
            "hotel_id",
            F.coalesce("_f.rating", F.lit(0)).alias("rating"),
            _text("_f.lastUpdate").alias("last_update"),
        )
    )


def parse_hotel_ratings(df: DataFrame) -> DataFrame:
    """Counts, overall rating and sentiments of the first ratings item."""
    first = F.get("_p.data", F.lit(0))
    return (
        _parsed(df, schemas.HOTEL_RATINGS_PAYLOAD)
        .withColumn("_f", first)
        .filter(F.col("_f").isNotNull())
        .select(
            "hotel_id",
            F.coalesce("_f.numberOfReviews", F.lit(0)).alias("number_of_reviews"),
            F.coalesce("_f.numberOfRatings", F.lit(0)).alias("number_of_ratings"),
            F.coalesce("_f.overallRating", F.lit(0)).alias("overall_rating"),
            F.col("_f.sentiments").alias("sentiments"),
            _text("_f.lastUpdate").alias("last_update"),
        )
    )


def parse_places(df: DataFrame, pos: str) -> DataFrame:
    """Place pages of a location search to hotels, the first page of an id wins.

    City and country come from the searched ``location``, state and postal code
    from the address.
    """
    items = _items(df, schemas.PLACES_PAYLOAD, "places")
    part = F.split("location", ",")
    address = address_parts(F.col("_i.formattedAddress"))
    hotels = items.select(
        prefixed_id("google", F.col("_i.id")).alias("hotel_id"),
        F.lit(GOOGLE).alias("source"),
        F.col("_i.id").alias("source_hotel_id"),
        _text("_i.displayName.text").alias("name"),
        trim_ws(F.get(part, F.lit(0))).alias("city"),
        trim_ws(F.get(part, F.lit(1))).alias("country"),
        _text("_i.formattedAddress").alias("street_address"),
        address["state"].alias("state_code"),
        address["zip"].alias("postal_code"),
        _number("_i.location.latLng.latitude").alias("latitude"),
        _number("_i.location.latLng.longitude").alias("longitude"),
        _number("_i.rating").alias("google_rating"),
        F.struct(pos, "_pos").alias("_order"),
    )
    return keep_first(hotels, ["hotel_id"], ["_order"]).drop("_order")


def parse_location_search(df: DataFrame) -> DataFrame:
    """Location-search answers to hotels; unreadable coordinates become 0."""
    items = _items(df, schemas.LOCATION_SEARCH_PAYLOAD, "data")
    part = F.split("location", ",")
    return items.select(
        prefixed_id("ta", F.col("_i.location_id")).alias("hotel_id"),
        F.lit(TRIPADVISOR).alias("source"),
        F.col("_i.location_id").alias("source_hotel_id"),
        _text("_i.name").alias("name"),
        trim_ws(F.get(part, F.lit(0))).alias("city"),
        trim_ws(F.get(part, F.lit(1))).alias("country"),
        _number("_i.rating").alias("tripadvisor_rating"),
        _text("_i.address_obj.street1").alias("street_address"),
        _text("_i.address_obj.postalcode").alias("postal_code"),
        F.coalesce(parse_float(F.col("_i.latitude")), F.lit(0.0)).alias("latitude"),
        F.coalesce(parse_float(F.col("_i.longitude")), F.lit(0.0)).alias("longitude"),
        _text("_i.phone").alias("phone"),
        _text("_i.website").alias("website"),
        _text("_i.email").alias("email"),
    )


def parse_business_search(df: DataFrame) -> DataFrame:
    """Business-search answers to hotels."""
    items = _items(df, schemas.BUSINESS_SEARCH_PAYLOAD, "businesses")
    return items.select(
        prefixed_id("yelp", F.col("_i.id")).alias("hotel_id"),
        F.lit(YELP).alias("source"),
        F.col("_i.id").alias("source_hotel_id"),
        _text("_i.name").alias("name"),
        _text("_i.location.city").alias("city"),
        _text("_i.location.country").alias("country"),
        _number("_i.coordinates.latitude").alias("latitude"),
        _number("_i.coordinates.longitude").alias("longitude"),
        _text("_i.location.address1").alias("street_address"),
        _text("_i.location.zip_code").alias("postal_code"),
        _text("_i.phone").alias("phone"),
    )


def parse_reviews_a(df: DataFrame, as_of: Column) -> DataFrame:
    """Location-review answers to reviews; reviews without a readable date are dropped."""
    items = _items(df, schemas.LOCATION_REVIEWS_PAYLOAD, "data")
    return items.select(
        "hotel_id",
        F.lit(TRIPADVISOR).alias("source"),
        sha_id(F.col("_i.text")).alias("source_review_id"),
        titled_text(F.col("_i.title"), F.col("_i.text")).alias("review_text"),
        _number("_i.rating").alias("rating"),
        review_date(F.col("_i.published_date"), as_of).alias("review_date"),
        _text("_i.user.username").alias("reviewer_name"),
        F.col("_i.user.user_location.name").alias("reviewer_location"),
        F.coalesce("_i.helpful_votes", F.lit(0)).alias("helpful_count"),
    ).filter(F.col("review_date").isNotNull())


def parse_reviews_b(df: DataFrame) -> DataFrame:
    """Place-details answers to reviews; each carries the first photo of its place."""
    photo = F.coalesce(F.get("_p.photos", F.lit(0))["name"], F.lit(""))
    items = _parsed(df, schemas.PLACE_DETAILS_PAYLOAD).select(
        "hotel_id", photo.alias("photo_name"), F.explode("_p.reviews").alias("_i")
    )
    return items.select(
        "hotel_id",
        F.lit(GOOGLE).alias("source"),
        sha_id(F.col("_i.text.text")).alias("source_review_id"),
        _text("_i.authorAttribution.displayName").alias("reviewer_name"),
        _text("_i.authorAttribution.uri").alias("reviewer_location"),
        _number("_i.rating").alias("rating"),
        _text("_i.text.text").alias("review_text"),
        rfc3339(F.col("_i.publishTime")).alias("review_date"),
        F.lit(True).alias("verified"),
        _text("_i.googleMapsUri").alias("google_maps_uri"),
        "photo_name",
    ).filter(F.col("review_date").isNotNull())


def parse_photo(df: DataFrame) -> DataFrame:
    """First photo of a place answer, '' when it has none."""
    photo = F.coalesce(F.get("_p.photos", F.lit(0))["name"], F.lit(""))
    kept = [c for c in df.columns if c != "payload"]
    return _parsed(df, schemas.PHOTO_PAYLOAD).select(*kept, photo.alias("photo_name"))


def parse_completions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model answers to item rows, and per query whether its answer failed to parse.

    Blank and ``null`` answers have no items. One leading fence, with or without
    a language, and one trailing fence are removed first; if that does not parse,
    every fence mark is removed. An answer must be a JSON array of objects and
    nothing else. ``item`` holds a whole item as JSON, also fields and types
    that the named columns have no place for.
    """
    text = trim_ws(F.coalesce("content", F.lit("")))
    fence = "```"
    inner = F.when(text.startswith(fence), F.regexp_replace(text, r"^```[a-z]*\s*", "")).otherwise(text)
    fenced = F.when(inner.endswith(fence), F.substring(inner, F.lit(1), F.length(inner) - 3)).otherwise(inner)
    bare = F.replace(text, F.lit(fence), F.lit(""))
    fields = StructType.fromDDL(f"items {schemas.COMPLETION_ITEMS}")["items"].dataType.elementType.fields

    def read(c: Column) -> Column:
        # As the value of a field the text is parsed strictly and to its end.
        whole = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
        items = F.try_variant_get(whole, "$.v", "array<variant>")
        objects = F.forall(items, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
        alone = F.try_variant_get(whole, "$", "map<string,variant>")
        return F.when(objects & (F.size(alone) == 1), items)

    none = text.isin("", "null")
    parsed = df.withColumn("_items", F.coalesce(read(fenced), read(bare)))
    failed = parsed.select(
        "query_id", (~none & F.col("_items").isNull()).alias("parse_failed")
    )
    items = parsed.filter(~none).select("query_id", F.posexplode("_items").alias("pos", "_i"))
    typed = [F.try_variant_get("_i", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    return items.select("query_id", "pos", *typed, F.to_json("_i").alias("item")), failed
