"""Keep-one, rank and top-n operators.

``row_number() <= n`` filters are limited inside every map task before the
exchange, so a hot key ships at most ``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.functions.text import text_hash
from staylens.operators.ranges import before, key_at, not_before, ranged

_RN = "_rn"
#: A page up to this place is cheaper as a top-n than by ranges.
PAGE_ROWS = 10_000


def first_per_key(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RN, rn).filter(F.col(_RN) <= n).drop(_RN)


def keep_first(df: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(p).asc() for p in pos])


def keep_last(df: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(p).desc() for p in pos])


def dedupe_by_hash(df: DataFrame) -> DataFrame:
    """One row per normalised review text: highest table_source, then highest id.

    The last tie is settled by a hash of the raw text and not by the text, so
    texts are shuffled only where the caller reads them.
    """
    text = F.col("review_text")
    hashed = df.withColumns({"review_text_hash": text_hash(text), "_raw": F.md5(text)})
    order = [F.desc("table_source"), F.desc("id"), F.asc("hotel_id"), F.asc("_raw")]
    return first_per_key(hashed, ["review_text_hash"], order).drop("_raw")


def top_cities(cities: DataFrame, n: int = 25) -> DataFrame:
    """Cities with most airports per country; ties by name."""
    order = [F.desc("airport_count"), F.asc("name"), F.asc("iata_code")]
    return first_per_key(cities, ["country"], order, n)


def rank_hits(hits: DataFrame, k: int | None = None) -> DataFrame:
    """1-based rank of the hits of each query, nearest first.

    With ``k`` only the nearest are ranked, and each task passes on at most k
    hits of a query.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("distance"), F.asc("id"))
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def reviews_for_hotel(df: DataFrame, hotel_id: str | Column) -> DataFrame:
    return df.filter(F.col("hotel_id") == hotel_id).orderBy(
        F.desc("review_date"), F.desc("created_at")
    )


def top_n(df: DataFrame, n: int) -> DataFrame:
    """Global top n by airport count, ties by name."""
    return df.orderBy(F.desc("airport_count"), F.asc("name"), F.asc("iata_code")).limit(n)


def slice_rows(df: DataFrame, key: list[str], offset: int = 0, limit: int | None = None,
               parts: int | None = None) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in the order of the unique ``key``, nulls first.

    A page among the first ``PAGE_ROWS`` rows is a top-n. Any other slice is a filter between
    the keys at its two ends, which are found by ranges of the keys alone; the filter
    reaches the scan, and no task sees the rows that are skipped.
    """
    if limit is not None and offset + limit <= PAGE_ROWS and parts is None:
        return df.orderBy(*key).offset(offset).limit(limit)
    ranges = ranged(df.select(*key), key, parts)
    start = key_at(ranges, key, offset)
    if start is None:
        return df.filter(F.lit(False))
    rows = df.filter(not_before(key, start))
    end = None if limit is None else key_at(ranges, key, offset + limit)
    return (rows if end is None else rows.filter(before(key, end))).orderBy(*key)
