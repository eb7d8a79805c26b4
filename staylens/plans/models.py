"""The relational models, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions.text import first_part, last_part, norm_key
from staylens.operators.aggregates import hotel_stats, low_review_flag, review_stats
from staylens.operators.filters import coverage_flags, non_null_text
from staylens.operators.joins import anti_hash, join_norm, reviews_hotels
from staylens.operators.sets import embedded_hashes, union_cities, union_hotels, union_reviews
from staylens.operators.windows import dedupe_by_hash

# Labels of the landed tables.
HOTEL_LABELS = ["bigHotels", "hotels", "hotels_old_amadeusdev"]
REVIEW_LABELS = ["main_hotel_reviews_all_110k", "bigReview", "reviews", "intermediate_upload"]
CITY_LABELS = ["bigCity", "cities", "airportCity"]
MISSING = "TRULY_MISSING"


def all_hotels(*arms: DataFrame) -> DataFrame:
    return union_hotels(dict(zip(HOTEL_LABELS, arms)))


def all_reviews(*arms: DataFrame) -> DataFrame:
    """Reviews of all tables, one row per normalised text."""
    return dedupe_by_hash(non_null_text(union_reviews(dict(zip(REVIEW_LABELS, arms)))))


def dim_cities(*arms: DataFrame, distinct_cities: bool = False) -> DataFrame:
    """City tables one after another; optionally one row per normalised name."""
    cities = union_cities(dict(zip(CITY_LABELS, arms)))
    if not distinct_cities:
        return cities
    order = F.array_position(F.array(*map(F.lit, CITY_LABELS)), F.col("city_source"))
    kept = F.min_by(F.struct(*cities.columns), F.struct(order, "city", "country"))
    return cities.groupBy(norm_key(F.col("city"))).agg(kept.alias("k")).select("k.*")


def city_coverage(cities: DataFrame, reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Review and hotel counts of every listed city with zero and low flags."""
    base = cities.select("city", "country", "continent")
    counted = review_stats(reviews, hotels).withColumnRenamed("city", "_city")
    stocked = hotel_stats(hotels).withColumnRenamed("city", "_city")
    joined = join_norm(base, counted, "city", "_city", ["review_count"])
    joined = join_norm(joined, stocked, "city", "_city", ["hotel_count"])
    return coverage_flags(joined).orderBy("review_count", "hotel_count")


def city_hotel_counts(cities: DataFrame, reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Hotels and reviewed hotels per city."""
    # Only distinct counts are asked for, so reviews shrink to their hotel ids.
    seen = reviews.select(F.col("hotel_id").alias("source_hotel_id")).distinct().withColumn(
        "hotel_id", F.col("source_hotel_id")
    )
    stock = hotels.select(
        "source_hotel_id", F.col("city").alias("_city"), F.col("country").alias("_country"),
        norm_key(F.col("city")).alias("_key"),
    ).distinct().join(seen, "source_hotel_id", "left")
    # Hotels and cities are made distinct before they meet, so repeated rows do not multiply.
    listed = cities.select("city", "country", "continent", norm_key(F.col("city")).alias("_key")).distinct()
    # Cities with hotels go through an inner join, whose hot cities can be split
    # on either side; the others are added by an anti join on the city keys.
    matched = stock.join(listed, "_key")
    placed = hotels.select(norm_key(F.col("city")).alias("_key")).distinct()
    unmatched = listed.join(placed, "_key", "left_anti")
    return (
        matched.unionByName(unmatched, allowMissingColumns=True)
        .groupBy(
            F.coalesce("_city", "city").alias("city"),
            F.coalesce("_country", "country").alias("country"),
            "continent",
        )
        .agg(
            F.count_distinct("source_hotel_id").alias("hotel_count"),
            F.count_distinct("hotel_id").alias("review_linked_hotel_count"),
        )
        .orderBy("hotel_count")
    )


def city_review_counts(cities: DataFrame, reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Reviews and reviewed hotels per city with the low flag."""
    # Reviews of one hotel and reviewer location move through the joins as one row.
    counted = reviews.groupBy("hotel_id", "reviewer_location").agg(F.count("*").alias("n"))
    located = reviews_hotels(
        counted,
        hotels.select(
            "source_hotel_id", F.col("city").alias("hotel_city"),
            F.col("country").alias("hotel_country"),
        ),
    )
    place = F.col("reviewer_location")
    mapped = located.groupBy(
        F.coalesce("hotel_city", first_part(place)).alias("city"),
        F.coalesce("hotel_country", last_part(place)).alias("country"),
        "hotel_id",
    ).agg(F.sum("n").alias("n"))
    named = cities.select(F.col("city").alias("_city"), "continent")
    joined = join_norm(mapped, named, "city", "_city", ["continent"])
    grouped = joined.groupBy("city", "country", "continent").agg(
        F.sum("n").alias("review_count"), F.count_distinct("hotel_id").alias("unique_hotels")
    )
    return low_review_flag(grouped).orderBy("review_count")


def missing_reviews_base(reviews: DataFrame, hotels: DataFrame, cities: DataFrame) -> DataFrame:
    """Reviews with their hotel and the city of the hotel or else of the reviewer."""
    joined = reviews_hotels(reviews, hotels.select(
        "source_hotel_id", F.col("hotel_name").alias("hotel_hotel_name"), "street_address",
        F.col("city").alias("hotel_city"), F.col("country").alias("hotel_country"),
    )).drop("source_hotel_id")
    located = joined.withColumn("_place", F.coalesce("hotel_city", "reviewer_location"))
    named = cities.select("city", F.col("country").alias("city_country"), "continent")
    return join_norm(located, named, "_place", "city", ["city", "city_country", "continent"]).drop(
        "_place"
    )


def missing_reviews(reviews: DataFrame, hotels: DataFrame, cities: DataFrame,
                    *embedded: DataFrame) -> DataFrame:
    """Reviews whose text was not embedded yet, with hotel and city."""
    # The anti join comes first: it removes reviews before the joins fan out.
    missing = anti_hash(reviews, embedded_hashes(*embedded))
    out = missing_reviews_base(missing, hotels, cities)
    return out.select(
        "id", "hotel_id", "source_review_id", "insert_id", "review_text", "reviewer_name",
        "rating", "review_date", "google_maps_uri", "photo_name", "table_source",
        "hotel_hotel_name", "street_address", "hotel_city", "hotel_country", "city",
        "city_country", "continent", F.lit(MISSING).alias("status"),
    ).orderBy("review_text")
