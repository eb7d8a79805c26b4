"""Unions of landed tables into one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from staylens.functions.text import text_hash
from staylens.operators.filters import align, with_provenance
from staylens.schemas import table

# Columns of the unified review and city tables.
REVIEW_COLUMNS = table("""
    id long, hotel_id string, source_review_id string, insert_id string, review_text string,
    reviewer_name string, reviewer_location string, rating double, review_date timestamp,
    google_maps_uri string, photo_name string
""")
CITY_COLUMNS = table("city string, country string, continent string")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_hotels(arms: dict[str, DataFrame]) -> DataFrame:
    """Hotel tables by label, one after another."""
    return union_all(*[with_provenance(df, label) for label, df in arms.items()])


def union_reviews(arms: dict[str, DataFrame]) -> DataFrame:
    """Review tables by label; columns an arm lacks are NULL."""
    return union_all(
        *[
            align(df, REVIEW_COLUMNS).withColumn("table_source", F.lit(label))
            for label, df in arms.items()
        ]
    )


def union_cities(arms: dict[str, DataFrame]) -> DataFrame:
    """City tables by label; columns an arm lacks are NULL."""
    return union_all(
        *[
            align(df.withColumnRenamed("name", "city"), CITY_COLUMNS).withColumn(
                "city_source", F.lit(label)
            )
            for label, df in arms.items()
        ]
    )


def embedded_hashes(*tables: DataFrame) -> DataFrame:
    """Distinct text hashes over all embedded tables."""
    hashes = [t.select(text_hash(F.col("review_text")).alias("review_text_hash")) for t in tables]
    return union_all(*hashes).distinct()
