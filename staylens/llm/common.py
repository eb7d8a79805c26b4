"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from staylens.session import shared_dir, store


#: Rows that travel to Python at once; texts can be long, so fewer than Spark's default.
ARROW_ROWS = 1000
#: Bytes of such rows, about: a row can hold a long text, or all members of a block.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; from here on this session sends small batches to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and go on from the stored table (cuts lineage)."""
    return store(df, shared_dir(df.sparkSession, label))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, left: str, right: str, label: str) -> DataFrame:
    """Smallest id reachable from every id that has a link: (id, component_id).

    Alternates the two star contractions on distinct links (larger neighbours
    move to the smallest neighbour, then smaller ones do), each a grouped
    minimum; rounds grow with the logarithm of a component's size. A hub is
    never gathered: its minimum is pre-aggregated and joined back, and that
    join can be split. Null ids and links of an id with itself are ignored. An
    empty input gives an empty result.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    # Directed from the larger to the smaller id.
    state = written(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    while True:
        # Large star: neighbours above u are linked to the smallest of u and its neighbours.
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = written(large, label)
        # Small star: neighbours below u, and u itself, are linked to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(lowest.select("u", F.col("m").alias("v")).union(moved).distinct(), label)
        # Done when the links are a star on each smallest id: no id has two
        # parents and no parent has a parent.
        open_ends = small.select(F.col("v").alias("u")).join(small.select("u").distinct(), "u", "left_semi")
        several = small.groupBy("u").count().where("count > 1")
        if open_ends.isEmpty() and several.isEmpty():
            return small.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
                small.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
            )
        state = small


# 64 slices of 32 768 bits: 256 KiB, whatever the input.
SLICES = 64


def bit_number(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLICES * 32768)) + 1


def bitmap(keys: DataFrame, *columns) -> DataFrame:
    """Fixed-size set of key hashes: at most SLICES rows of 4 KiB."""
    number = bit_number(*columns)
    return keys.groupBy(F.bitmap_bucket_number(number).alias("slice")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def marked(rows: DataFrame, slices: DataFrame, *columns) -> DataFrame:
    """Rows with ``is_set``: false only if their key is certainly not in the bitmap."""
    number = bit_number(*columns)
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("slice", F.bitmap_bucket_number(number))
        .join(F.broadcast(slices), "slice", "left")
        .withColumn("is_set", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
        .drop("slice", "bits")
    )


def positions(rows: DataFrame, tree: str, *order: str, label: str) -> DataFrame:
    """Rows with ``pos``, the place (from 0) within their ``tree`` by ``order``, and ``n``, the rows of that tree.

    No tree is gathered, however many rows it has: rows are range-partitioned
    and sorted, each partition counts its rows per tree, and only these counts
    are summed up in order. Nulls sort first; among rows that tie in every
    column of ``order`` the place is arbitrary. An empty input gives an empty
    result.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie").drop("_tie")
    placed = written(dealt.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), label)
    counts = placed.groupBy(F.col("_part").alias("_in"), F.col(tree).alias("_of")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_of")
    before = whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_in", "_of", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"))
    return placed.join(shifts, (F.col("_part") == F.col("_in")) & F.col(tree).eqNullSafe(F.col("_of"))).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
