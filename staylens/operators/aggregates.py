"""Grouped counts, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staylens.functions.text import first_part, place_label
from staylens.operators.filters import LOW_COUNT, non_empty
from staylens.operators.joins import reviews_hotels

# Fixed values of the reports.
LOW_HOTELS = 10


def _reviews_per_hotel(reviews: DataFrame, *keys: str) -> DataFrame:
    """Review count per hotel and key; shrinks hot hotels before any join."""
    return reviews.groupBy("hotel_id", *keys).agg(F.count("*").alias("n"))


def review_stats(reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Reviews and distinct reviewed hotels per city.

    The city is the hotel's, or else the first part of the reviewer location.
    """
    counted = _reviews_per_hotel(reviews, "reviewer_location")
    located = reviews_hotels(counted, hotels.select("source_hotel_id", "city"))
    city = F.coalesce("city", first_part(F.col("reviewer_location")))
    return located.groupBy(city.alias("city")).agg(
        F.sum("n").alias("review_count"), F.count_distinct("hotel_id").alias("unique_hotels")
    )


def hotel_stats(hotels: DataFrame) -> DataFrame:
    """Distinct hotels per city."""
    return hotels.groupBy("city").agg(F.count_distinct("source_hotel_id").alias("hotel_count"))


def low_review_flag(df: DataFrame, n: int = LOW_COUNT) -> DataFrame:
    return df.withColumn("is_low_review_city", F.col("review_count") < n)


def low_hotel_cities(df: DataFrame, n: int = LOW_HOTELS) -> DataFrame:
    """Hotel counts with the low flag named in the model documentation."""
    return df.withColumn("is_low_hotel_city", F.col("hotel_count") < n)


def distinct_locations(items: DataFrame) -> DataFrame:
    """Sorted ``city, country`` labels per continent."""
    named = items.filter(non_empty("continent", "city", "country"))
    labels = named.select(
        "continent", place_label(F.col("city"), F.col("country")).alias("label")
    ).distinct()
    return labels.groupBy("continent").agg(
        F.array_sort(F.collect_list("label")).alias("city_countries")
    )


def airport_cities(airports: DataFrame) -> DataFrame:
    """Airports per country and city, with the spelling and code seen first."""
    matched = airports.filter(F.col("iso2").isNotNull())
    first = F.min(F.struct("pos", "city", "iata"))
    grouped = matched.groupBy("iso2", F.lower("city").alias("_city")).agg(
        F.first("country_name").alias("country"),
        F.first("codes").alias("country_codes"),
        F.count("*").cast("int").alias("airport_count"),
        first.alias("_first"),
    )
    return grouped.select(
        F.col("_first.iata").alias("iata_code"), F.col("_first.city").alias("name"),
        "country", "airport_count", "country_codes",
    )


def airport_city_codes(airports: DataFrame) -> DataFrame:
    """Airports per city with their distinct codes in the order first seen."""
    counted = airports.groupBy("city", "country", "iata").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos")
    )
    codes = F.array_sort(F.collect_list(F.struct("pos", "iata")))
    return counted.groupBy("city", "country").agg(
        F.sum("n").alias("airport_count"),
        F.transform(codes, lambda c: c["iata"]).alias("iatas"),
    )


def one_row_per_code(cities: DataFrame) -> DataFrame:
    """Insert rows of the city table: one per airport code."""
    return cities.select(
        F.explode("iatas").alias("iata_code"), F.col("city").alias("name"), "country",
        "airport_count",
    )


def saved_by_source(df: DataFrame) -> DataFrame:
    """Rows per provider and, with a NULL provider, the grand total."""
    return df.rollup("source").agg(F.count("*").alias("saved"))


def result_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, mean rating with one decimal (0.0 without ratings), distinct cities."""
    mean = F.round(F.avg("rating"), 1)
    return df.groupBy(*keys).agg(
        F.count("*").alias("result_count"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_rating"),
        F.count_distinct("city").alias("city_count"),
    )


def duplicate_reviews(reviews: DataFrame) -> DataFrame:
    """Review keys that occur more than once."""
    counted = reviews.groupBy("source", "source_review_id").agg(F.count("*").alias("copies"))
    return counted.filter(F.col("copies") > 1)


def refresh_audit(targets: DataFrame) -> DataFrame:
    """Rows read, hotels kept, rows skipped for an empty photo or a repeated hotel."""
    per_hotel = targets.groupBy("hotel_id").agg(
        F.count("*").alias("read"), F.count_if(non_empty("photo_name")).alias("with_photo")
    )
    return per_hotel.agg(
        F.coalesce(F.sum("read"), F.lit(0)).alias("read"),
        F.count_if(F.col("with_photo") > 0).alias("matched"),
        F.coalesce(F.sum(F.col("read") - F.col("with_photo")), F.lit(0)).alias("skipped_empty"),
        F.coalesce(F.sum(F.greatest(F.col("with_photo") - 1, F.lit(0))), F.lit(0)).alias(
            "skipped_duplicate"
        ),
    )
