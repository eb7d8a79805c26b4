"""Places in a global order, found range by range.

Rows are dealt out by ranges of the order and counted per range. The counts, one
row per range, say in which range a place lies; no task sees more than one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from staylens.session import shared_dir, store

RANGE = "_range"


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """The rows as a written table, with the number of their range; numbers ascend with the order.

    The table fixes the ranges: a later reader, or a task run again, sees the same ones.
    Without ``parts`` Spark chooses their number by the size of the data.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return store(dealt.withColumn(RANGE, F.spark_partition_id()), shared_dir(df.sparkSession, "ranges"))


def key_at(ranges: DataFrame, key: list[str], position: int) -> Row | None:
    """The key at a position, counted from 0, of the order; None past the end."""
    # One row per range, so at most as many as shuffle partitions.
    counts = sorted(tuple(r) for r in ranges.groupBy(RANGE).count().collect())
    for number, count in counts:
        if position < count:
            place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*key))
            inside = ranges.filter(F.col(RANGE) == number).withColumn("_place", place)
            return inside.filter(F.col("_place") == position + 1).select(*key).first()
        position -= count
    return None


def before(key: list[str], row: Row) -> Column:
    """Rows whose key comes before the given one, nulls first."""
    out = F.lit(False)
    for c in reversed(key):
        if row[c] is None:
            out = F.col(c).isNull() & out
        else:
            out = F.col(c).isNull() | (F.col(c) < row[c]) | ((F.col(c) == row[c]) & out)
    return out


def not_before(key: list[str], row: Row) -> Column:
    """Rows whose key is the given one or comes after it, nulls first."""
    out = F.lit(True)
    for c in reversed(key):
        if row[c] is None:
            out = F.col(c).isNotNull() | out
        else:
            out = (F.col(c) > row[c]) | ((F.col(c) == row[c]) & out)
    return out


def weighted_ranks(df: DataFrame, keys: list[str], value: str, weight: str, shares: list[float],
                   parts: int | None = None) -> DataFrame:
    """Per group the total weight and, for each share, the smallest value that reaches it.

    A share is reached where the weights up to the value sum to it; a share of nothing
    is reached by the smallest value. Null values weigh nothing. Each group has at most
    one row per range in the sums, and only ranges that hold a wanted place are ranked.
    """
    ranges = ranged(df.select(*keys, value, weight), [*keys, value], parts)
    per_range = ranges.groupBy(*keys, RANGE).agg(F.sum(weight).alias("_sum"))
    group = Window.partitionBy(*keys)
    sums = per_range.withColumns({
        "_before": F.sum("_sum").over(group.orderBy(RANGE)) - F.col("_sum"),
        "_all": F.sum("_sum").over(group),
    })
    places = [
        F.struct(F.lit(i).alias("share"), F.greatest(F.ceil(F.col("_all") * s), F.lit(1)).alias("place"))
        for i, s in enumerate(shares)
    ]
    wanted = sums.select(*keys, RANGE, "_before", "_sum", F.explode(F.array(*places)).alias("_w"))
    inside = (F.col("_w.place") > F.col("_before")) & (
        F.col("_w.place") <= F.col("_before") + F.col("_sum"))
    wanted = wanted.filter(inside).groupBy(*keys, RANGE).agg(
        F.collect_list(F.struct(
            F.col("_w.share").alias("share"), (F.col("_w.place") - F.col("_before")).alias("place")
        )).alias("_w"))

    same = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*keys, RANGE]],
    )
    met = ranges.filter(F.col(value).isNotNull()).alias("r").join(wanted.alias("w"), same).select(
        *[F.col(f"r.{c}").alias(c) for c in [*keys, RANGE, value, weight]], "w._w")
    upto = F.sum(weight).over(Window.partitionBy(*keys, RANGE).orderBy(value))
    ranked = met.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col(weight))
    reached = F.filter(
        "_w", lambda w: (w["place"] > F.col("_from")) & (w["place"] <= F.col("_upto")))
    found = ranked.select(*keys, F.col(value).alias("_value"), F.explode(reached).alias("_w")).select(
        *keys, F.lit(0).cast("bigint").alias("_sum"), F.col("_w.share").alias("_share"), "_value")
    totals = per_range.select(
        *keys, "_sum", F.lit(None).cast("int").alias("_share"),
        F.lit(None).cast(df.schema[value].dataType).alias("_value"))
    at = [F.max(F.when(F.col("_share") == i, F.col("_value"))) for i in range(len(shares))]
    return totals.unionByName(found).groupBy(*keys).agg(
        F.sum("_sum").alias("total"), F.array(*at).alias("values"))
