"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from staylens.catalog.tables import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@lru_cache(maxsize=8)
def tables_for(spark: SparkSession, folder: str) -> Tables:
    """Tables of a folder; their plans are shared by the queries of a session."""
    # The given times carry no zone and are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Tables(spark, folder)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the SQL of the same result."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(tables_for(spark, folder))
        if sql is not None:
            SQL[name] = with_tables(sql)
        return fn

    return wrap
