"""Joins between reviews, hotels, cities, hits and airports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions.text import norm_key, parse_int, place_label
from staylens.operators.filters import non_empty
from staylens.operators.windows import first_per_key

# Fixed values of the hotel search requests.
SEARCH_PREFIXES = ["quiet hotels near", "best hotels near", "cheap hotels near", "quality hotels in"]
RESULTS_PER_PAGE = 20
PAGES_PER_SEARCH = 3
PHOTO_SOURCE = "google"


def reviews_hotels(reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Every review with each hotel of its id; hotel columns NULL without a match."""
    return reviews.join(hotels, hotels.source_hotel_id == reviews.hotel_id, "left")


def join_norm(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              keep: list[str]) -> DataFrame:
    """Left join on normalised names; ``keep`` are the right columns to carry over."""
    key = "_key"
    lookup = right.select(norm_key(F.col(right_key)).alias(key), *keep)
    return left.withColumn(key, norm_key(F.col(left_key))).join(lookup, key, "left").drop(key)


def anti_hash(reviews: DataFrame, hashes: DataFrame) -> DataFrame:
    """Reviews whose text hash is in none of the given hashes."""
    return reviews.join(hashes, "review_text_hash", "left_anti")


def cities_without_hotels(cities: DataFrame, hotels: DataFrame) -> DataFrame:
    """Cities with no hotel of exactly that city and country."""
    # Distinct first: a city of many hotels travels as one row.
    known = hotels.select(F.col("city").alias("name"), "country").distinct()
    return cities.join(known, ["name", "country"], "left_anti")


def hotels_in_continents(hotels: DataFrame, cities: DataFrame, continents: list[str]) -> DataFrame:
    wanted = cities.filter(F.col("continent").isin(continents)).select(
        F.col("name").alias("city"), "country", "continent"
    )
    return hotels.join(wanted, ["city", "country"])


def by_ids(df: DataFrame, ids: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose id is in a list of textual ids; texts that are no integer are skipped."""
    wanted = ids.select(parse_int(F.col("id")).alias(col)).filter(F.col(col).isNotNull())
    return df.join(wanted, col, "left_semi")


def hydrate(items: DataFrame, hotels: DataFrame) -> DataFrame:
    """Attach the street address of the hotel with the item's hotel name."""
    address = hotels.select(F.col("name").alias("hotel_name"), "source_hotel_id", "street_address")
    return items.join(address, "hotel_name")


def photo_targets_v1(items: DataFrame, hotels: DataFrame) -> DataFrame:
    """Distinct (hotel name, hotel id) that occur among the indexed reviews."""
    named = hotels.filter(non_empty("hotel_id")).select(F.col("name").alias("hotel_name"), "hotel_id")
    shown = items.select("hotel_name").distinct()
    return named.distinct().join(shown, "hotel_name", "left_semi")


def photo_targets_v2(items: DataFrame, hotels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hotels whose indexed photo is the photo of one of their own reviews."""
    shown = items.select("hotel_name", "photo_name").distinct()
    own = (
        reviews.filter(non_empty("hotel_id") & (F.col("source") == PHOTO_SOURCE))
        .select("hotel_id", "photo_name")
        .distinct()
    )
    named = hotels.select(
        F.col("name").alias("hotel_name"), F.col("source_hotel_id").alias("hotel_id")
    ).distinct()
    return own.join(named, "hotel_id").join(shown, ["hotel_name", "photo_name"], "left_semi").select(
        "hotel_name", "hotel_id", "photo_name"
    )


def denormalise(reviews: DataFrame, hotels: DataFrame, cities: DataFrame) -> DataFrame:
    """Review with hotel name and city name."""
    h = hotels.select(
        F.col("source_hotel_id").alias("hotel_id"), F.col("name").alias("hotel_name"),
        F.col("city").alias("_city"), F.col("country").alias("_country"),
    )
    c = cities.select(
        F.col("name").alias("_city"), F.col("country").alias("_country"),
        F.col("name").alias("city_name"),
    )
    return (
        reviews.select("source_review_id", "review_text", "rating", "hotel_id")
        .join(h, "hotel_id", "left")
        .join(c, ["_city", "_country"], "left")
        .drop("_city", "_country")
    )


def attach_rank(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with their metadata in rank order; hits without metadata are dropped.

    An id with several metadata rows keeps the one of the smallest hotel id.
    """
    usable = hits.withColumn("id", parse_int(F.col("id").cast("string")))
    joined = usable.join(meta, "id")
    return first_per_key(joined, ["query_id", "rank", "id"], [F.asc("source_hotel_id")])


def match_country(airports: DataFrame, countries: DataFrame) -> DataFrame:
    """Country of each airport: equal name first, else the longest name contained in it.

    The distinct airport countries are cut into substrings of the lengths that
    country names have, which turns the containment test into an equi-join.
    """
    lengths = countries.agg(F.collect_set(F.length("name")).alias("_lengths"))
    # One row: the different lengths of country names.
    spelled = airports.select(F.lower("country").alias("_spelled")).distinct().crossJoin(F.broadcast(lengths))
    n = F.length("_spelled")
    parts = F.flatten(
        F.transform(
            F.filter("_lengths", lambda k: (k > 0) & (k <= n)),
            lambda k: F.transform(
                F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("_spelled"), i, k)
            ),
        )
    )
    pieces = spelled.filter(n > 0).select("_spelled", F.explode(F.array_distinct(parts)).alias("_piece"))
    named = countries.select(
        F.lower("name").alias("_piece"), F.col("name").alias("country_name"), "iso2", "codes"
    )
    order = [
        F.desc(F.col("_piece") == F.col("_spelled")),
        F.desc(F.length("_piece")),
        F.asc("iso2"),
    ]
    best = first_per_key(pieces.join(named, "_piece"), ["_spelled"], order).drop("_piece")
    return (
        airports.withColumn("_spelled", F.lower("country")).join(best, "_spelled", "left").drop("_spelled")
    )


def pending(hotels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hotels of which no review was fetched yet from their source."""
    fetched = reviews.select("hotel_id", "source").distinct()
    return hotels.join(fetched, ["hotel_id", "source"], "left_anti")


def search_requests(cities: DataFrame, prefixes: list[str] = SEARCH_PREFIXES) -> DataFrame:
    """One text search per prefix and location."""
    location = place_label(F.col("name"), F.col("country"))
    rows = cities.select(
        location.alias("location"), F.explode(F.array(*map(F.lit, prefixes))).alias("prefix")
    )
    return rows.select(
        F.concat_ws(" ", "prefix", "location").alias("text_query"),
        "location",
        F.lit(RESULTS_PER_PAGE).alias("max_result_count"),
        F.lit(PAGES_PER_SEARCH).alias("max_pages"),
    )
