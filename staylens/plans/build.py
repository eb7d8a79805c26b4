"""Build every model once, in dependency order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from staylens.plans import models
from staylens.session import store


def build_models(
    folder: str,
    hotels: list[DataFrame],
    reviews: list[DataFrame],
    cities: list[DataFrame],
    embedded: list[DataFrame],
) -> dict[str, DataFrame]:
    """Write the models below ``folder`` and return them as tables.

    The unified reviews feed four models. They are hashed and deduplicated once
    and read back by column, so the counts never touch the review texts again.
    """

    def stored(name: str, df: DataFrame) -> DataFrame:
        return store(df, f"{folder}/{name}")

    all_hotels = stored("all_hotels", models.all_hotels(*hotels))
    all_reviews = stored("all_reviews", models.all_reviews(*reviews))
    dim_cities = stored("dim_cities", models.dim_cities(*cities))
    inputs = (dim_cities, all_reviews, all_hotels)
    return {
        "all_hotels": all_hotels,
        "all_reviews": all_reviews,
        "dim_cities": dim_cities,
        "city_coverage": stored("city_coverage", models.city_coverage(*inputs)),
        "city_hotel_counts": stored("city_hotel_counts", models.city_hotel_counts(*inputs)),
        "city_review_counts": stored("city_review_counts", models.city_review_counts(*inputs)),
        "missing_reviews": stored(
            "missing_reviews",
            models.missing_reviews(all_reviews, all_hotels, dim_cities, *embedded),
        ),
    }
