"""Keyed merges as functions from (target, updates) to the new target.

Updates are reduced to one row per key first, so no merge fans out. With a
table format that supports it, each plan is one ``MERGE INTO``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from staylens.functions.text import sha_id, trim_ws
from staylens.operators.filters import non_empty
from staylens.operators.windows import keep_first, keep_last
from staylens.session import shared_dir, store

# Overwritten columns and rating columns per source.
HOTEL_UPSERT_COLUMNS = [
    "source", "name", "city", "country", "street_address", "postal_code", "state_code", "type",
    "dupe_id", "iata_code", "last_update",
]
CITY_UPSERT_COLUMNS = ["name", "country", "airport_count", "country_codes"]
RATING_COLUMNS = {
    "amadeus": "amadeus_rating",
    "expedia": "expedia_rating",
    "tripadvisorAPI": "tripadvisor_rating",
    "google": "google_rating",
    "booking": "booking_rating",
}


def _set(c: Column, dtype: T.DataType) -> Column:
    """The value when it counts as given; zero values count as absent."""
    if isinstance(dtype, T.StringType):
        return F.when(c != "", c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, c)
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, c)
    return c


def _merge(target: DataFrame, updates: DataFrame, key: str, merged: dict[str, Column]) -> DataFrame:
    """Matched rows take ``merged``, others stay, and updates of new keys are added.

    ``merged`` may refer to target ``t`` and update ``u`` columns; updates hold
    one row per key. Left joins let small updates be broadcast, so a large
    target is not shuffled for them, which a full outer join would force. The
    reduced updates are written once and read by all three joins.
    """
    updates = store(updates, shared_dir(updates.sparkSession, "merge"))
    t, u = target.alias("t"), updates.alias("u")
    columns = [
        F.coalesce(f"t.{key}", f"u.{key}").alias(key) if c == key else merged[c].alias(c)
        for c in target.columns
    ]
    same = F.col(f"t.{key}") == F.col(f"u.{key}")
    kept = t.join(u, same, "left").select(*columns)
    known = target.select(key).join(updates.select(key), key, "left_semi")
    fresh = updates.join(known, key, "left_anti").alias("u")
    # New rows meet no target row: the same expressions with an empty target.
    added = fresh.join(target.limit(0).alias("t"), same, "left").select(*columns)
    return kept.unionByName(added)


def upsert_hotels(target: DataFrame, updates: DataFrame, pos: str, key: str = "hotel_id") -> DataFrame:
    """Insert new hotels; on a match only fields with a non-zero value overwrite.

    The updates of one hotel are applied in order of ``pos``: per field the last
    given value wins.
    """
    fields = [f for f in target.schema if f.name != key]
    latest = updates.groupBy(key).agg(
        *[
            F.coalesce(
                F.max_by(f.name, F.when(_set(F.col(f.name), f.dataType).isNotNull(), F.col(pos))),
                F.max(f.name),
            ).alias(f.name)
            for f in fields
            if f.name in updates.columns
        ]
    )
    merged = {}
    for f in fields:
        if f.name in updates.columns:
            given = _set(F.col(f"u.{f.name}"), f.dataType)
            merged[f.name] = F.coalesce(given, F.col(f"t.{f.name}"), F.col(f"u.{f.name}"))
        else:
            merged[f.name] = F.col(f"t.{f.name}")
    return _merge(target, latest, key, merged)


def upsert_list(target: DataFrame, updates: DataFrame, key: str, columns: list[str],
                pos: str) -> DataFrame:
    """Insert new rows; on a match the listed columns overwrite, zero values included.

    An inserted row takes the first update's other columns and the last
    update's listed ones.
    """
    others = [c for c in target.columns if c != key and c not in columns and c in updates.columns]
    listed = [c for c in columns if c in target.columns and c in updates.columns]
    once = updates.groupBy(key).agg(
        F.max_by(F.struct(*listed), pos).alias("_last"),
        F.min_by(F.struct(F.lit(True).alias("_given"), *others), pos).alias("_first"),
    )
    new = F.col(f"t.{key}").isNull()
    matched = F.col(f"u.{key}").isNotNull()
    merged = {}
    for c in target.columns:
        if c in listed:
            merged[c] = F.when(matched, F.col(f"u._last.{c}")).otherwise(F.col(f"t.{c}"))
        elif c in others:
            merged[c] = F.when(new, F.col(f"u._first.{c}")).otherwise(F.col(f"t.{c}"))
        else:
            merged[c] = F.col(f"t.{c}")
    return _merge(target, once, key, merged)


def upsert_hotels_list(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    return upsert_list(target, updates, "hotel_id", HOTEL_UPSERT_COLUMNS, pos)


def upsert_cities(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    return upsert_list(target, updates, "iata_code", CITY_UPSERT_COLUMNS, pos)


def with_review_key(reviews: DataFrame) -> DataFrame:
    """Fill a blank source_review_id with the hash of the review text."""
    given = F.col("source_review_id")
    blank = F.coalesce(trim_ws(given) == "", F.lit(True))
    return reviews.withColumn(
        "source_review_id", F.when(blank, sha_id(F.col("review_text"))).otherwise(given)
    )


def insert_reviews(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    """Add reviews whose (source, source_review_id) is not stored; first of a batch wins."""
    key = ["source", "source_review_id"]
    once = keep_first(with_review_key(updates), key, [pos]).drop(pos)
    fresh = once.join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def _patch(target: DataFrame, updates: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Left join on a unique key; matched rows take ``changes``, others stay."""
    t, u = target.alias("t"), updates.alias("u")
    matched = F.col(f"u.{key}").isNotNull()
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        out.append(F.when(matched, changes[c]).otherwise(old).alias(c) if c in changes else old)
    return t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "left").select(*out)


def apply_ratings(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    """Route a rating to the column of its source; an unknown source fails the job."""
    known = F.col("source").isin(*RATING_COLUMNS)
    message = F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("")))
    checked = updates.withColumn(
        "source", F.when(known, F.col("source")).otherwise(F.raise_error(message))
    )
    wide = checked.groupBy("hotel_id").agg(
        *[
            F.max_by(
                F.struct(F.col("rating").alias("value")),
                F.when(F.col("source") == source, F.col(pos)),
            ).alias(column)
            for source, column in RATING_COLUMNS.items()
        ]
    )
    for column in RATING_COLUMNS.values():
        if column not in target.columns:
            target = target.withColumn(column, F.lit(None).cast("double"))
    changes = {
        c: F.when(F.col(f"u.{c}").isNotNull(), F.col(f"u.{c}.value")).otherwise(F.col(f"t.{c}"))
        for c in RATING_COLUMNS.values()
    }
    return _patch(target, wide, "hotel_id", changes)


def apply_recommendation(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    """Overwrite the four recommendation columns of matched hotels."""
    columns = ["recommended", "quality", "quiet", "important_note"]
    last = keep_last(updates, ["hotel_id"], [pos])
    return _patch(target, last, "hotel_id", {c: F.col(f"u.{c}") for c in columns})


def apply_admin_flag(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    last = keep_last(updates, ["hotel_id"], [pos])
    return _patch(target, last, "hotel_id", {"admin_flag": F.col("u.admin_flag")})


def apply_search_rating(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    """Rating and update time of a hotel-search answer."""
    last = keep_last(updates, ["hotel_id"], [pos])
    changes = {
        "amadeus_rating": F.col("u.rating").cast("double"),
        "last_update": F.col("u.last_update"),
    }
    return _patch(target, last, "hotel_id", changes)


def apply_provider_ratings(target: DataFrame, updates: DataFrame, pos: str) -> DataFrame:
    """Counts, overall rating and sentiments of a ratings answer."""
    last = keep_last(updates, ["hotel_id"], [pos])
    changes = {
        "number_of_reviews": F.col("u.number_of_reviews"),
        "number_of_ratings": F.col("u.number_of_ratings"),
        "overall_rating": F.col("u.overall_rating").cast("double"),
        "sentiments": F.to_json("u.sentiments"),
    }
    return _patch(target, last, "hotel_id", changes)


def refresh_photos_v1(target: DataFrame, photos: DataFrame, pos: str, name_col: str) -> DataFrame:
    """New photo of every matched hotel name; a blank one overwrites too."""
    last = keep_last(photos, ["hotel_name"], [pos]).select(
        F.col("hotel_name").alias(name_col), F.col("photo_name").alias("_photo")
    )
    if "photo_name" not in target.columns:
        target = target.withColumn("photo_name", F.lit(None).cast("string"))
    return _patch(target, last, name_col, {"photo_name": F.coalesce("u._photo", F.lit(""))})


def refresh_photos_v2(reviews: DataFrame, items: DataFrame, photos: DataFrame,
                      pos: str) -> tuple[DataFrame, DataFrame]:
    """New photos on reviews (by hotel id) and index rows (by hotel name); blanks are skipped.

    Namesakes share the photo fetched last for their name.
    """
    by_name = keep_last(photos, ["hotel_name"], [pos]).filter(non_empty("photo_name"))
    by_name = by_name.select("hotel_name", F.col("photo_name").alias("_photo"))
    hotels = keep_last(photos, ["hotel_id"], [pos]).select("hotel_id", "hotel_name")
    by_id = hotels.join(by_name, "hotel_name").select("hotel_id", "_photo")
    change = {"photo_name": F.col("u._photo")}
    return (
        _patch(reviews, by_id, "hotel_id", change),
        _patch(items, by_name, "hotel_name", change),
    )
