"""Scans of landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType


def scan(spark: SparkSession, folder: str, table: str, schema: StructType | None = None) -> DataFrame:
    """One landed table as typed rows."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def drift(stored: StructType, wanted: StructType) -> list[tuple[str, DataType | None, DataType | None, str]]:
    """(column, stored type, wanted type, change) of every column; change is same, cast, missing or added."""
    have = {f.name.lower(): f.dataType for f in stored}
    want = {f.name.lower(): f.dataType for f in wanted}
    out = []
    for name, kind in want.items():
        change = "missing" if name not in have else "same" if have[name] == kind else "cast"
        out.append((name, have.get(name), kind, change))
    return out + [(name, kind, None, "added") for name, kind in have.items() if name not in want]


def scan_checked(spark: SparkSession, folder: str, table: str,
                 wanted: StructType) -> tuple[DataFrame, DataFrame]:
    """One landed table in the wanted schema, and a report of how the stored one differs.

    Stored columns of another type are cast, values that do not fit become null and are
    counted in the report; missing columns are null, added ones are left out. Column
    names match in any case. A missing column that must not be null raises ``ValueError``.
    The report has column, stored, wanted, change and lost, the values a cast lost; only
    the columns that are cast are read for it.
    """
    df = scan(spark, folder, table)
    changes = drift(df.schema, wanted)
    needed = {f.name.lower() for f in wanted if not f.nullable}
    absent = [name for name, _, _, change in changes if change == "missing" and name in needed]
    if absent:
        raise ValueError(f"{table} lacks {absent}")
    names = {f.name.lower(): f.name for f in wanted}
    columns, report = [], []
    for name, stored, kind, change in changes:
        lost = F.lit(0).cast("long")
        if change == "cast":
            fitted = F.col(name).try_cast(kind)
            lost = F.count_if(F.col(name).isNotNull() & fitted.isNull())
            columns.append(fitted.alias(names[name]))
        elif change != "added":
            value = F.lit(None).cast(kind) if change == "missing" else F.col(name)
            columns.append(value.alias(names[name]))
        types = [F.lit(t.simpleString() if t else None).cast("string") for t in (stored, kind)]
        report.append(F.struct(
            F.lit(name).alias("column"), types[0].alias("stored"), types[1].alias("wanted"),
            F.lit(change).alias("change"), lost.alias("lost")))
    told = df.agg(F.count("*").alias("_rows"), F.array(*report).alias("_r")).select(F.inline("_r"))
    return df.select(*columns), told


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan with fewer splits than cores.

    Only for scans: a table of many files already has enough splits and is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
              parts: int = 64) -> DataFrame:
    """A row-store table read in parallel key ranges."""
    low, high = bounds
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high,
                           numPartitions=parts)


def by_id(df: DataFrame, value: str | int, col: str = "id") -> DataFrame:
    """Point lookup; a value that is no integer raises ``ValueError``."""
    return df.filter(F.col(col) == F.lit(int(value)))


def export_reviews(df: DataFrame) -> DataFrame:
    """Columns of a review that go to the warehouse."""
    return df.select("hotel_id", "review_text", "reviewer_name", "rating", "city", "country")
