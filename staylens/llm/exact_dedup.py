"""Exact deduplication by progressive refinement (operator 10).

Rows are grouped by length, then by a hash of the first characters; only rows
of groups that still hold several rows have their whole text hashed. The
lengths and prefix hashes of surviving groups travel to the scan as a bitmap of
fixed size, so the filter costs the same at any input size: a bit set by
another group only means that a text is hashed although it did not have to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staylens.llm.common import bitmap, marked, text_or_empty, written

PREFIX_CHARS = 64


def _narrow(df: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(
        F.col(id_col).alias("id"), text.alias("body"), F.octet_length(text).cast("long").alias("size"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
        *[expr.alias(name) for name, expr in carry.items()],
    )


def surviving_groups(rows: DataFrame) -> DataFrame:
    """Bitmap slices of the (length, prefix hash) groups that hold several rows.

    The first grouping counts rows per length and prefix hash map-side; lengths
    with one row leave before prefixes are looked at.
    """
    groups = rows.groupBy("size", "prefix").agg(F.count("*").alias("n"))
    lengths = groups.groupBy("size").agg(F.sum("n").alias("n")).where("n > 1").select("size")
    kept = groups.where("n > 1").join(lengths, "size", "left_semi")
    return bitmap(kept, "size", "prefix")


def _settled(df: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    rows = _narrow(df, id_col, text_col, carry)
    stored = written(
        marked(rows, surviving_groups(rows), "size", "prefix").select(
            "id", "size", "prefix", F.when(F.col("is_set"), F.sha2("body", 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"), *carry,
        ),
        "exact-dedup",
    )
    groups = (
        stored.where("digest is not null").groupBy("size", "digest")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1")
    )
    return stored.join(groups, ["size", "digest"], "left").select(
        "id", "size", "prefix", "digest",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"), *carry,
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the carried expressions.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    Of equal texts the row with the largest id stays. Of rows repeated with the
    same id and text exactly one is kept. Null ids sort below all others. An
    empty table gives an empty result. Other columns are ignored.

    Only narrow rows are shuffled (never texts). A group of copies of any size
    is reduced map-side to its largest id and count before it meets its rows.
    """
    carry = carry or {}
    return _settled(df, id_col, text_col, carry).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", *carry
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns unchanged.

    Texts of ids that occur once are only filtered; where an id occurs in
    several rows, those rows are matched by their text as well, and of rows with equal
    id and text one stays. A null text counts as empty; an empty table gives an
    empty result; columns may have any names.
    """
    found = written(_settled(df, id_col, text_col, {}), "exact-kept")
    per_id = found.groupBy("id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    # Stored, so that its size is known and texts are not shuffled to meet a few ids.
    touched = written(
        per_id.where("n_kept < n").select(F.col("id").alias("gone"), (F.col("n_kept") > 0).alias("mixed")), "exact-gone")
    text = text_or_empty(text_col)
    # The given columns travel as one, so that no name can clash.
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), text.alias("body"))
    kept = rows.join(touched, F.col("own").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
    mixed = touched.where("mixed").select(F.col("gone").alias("mixed"))
    if mixed.isEmpty():
        return kept
    staying = found.where("kept").join(mixed, F.col("id").eqNullSafe(F.col("mixed"))).select("id", "size", "prefix", "digest")
    again = rows.join(
        staying,
        F.col("own").eqNullSafe(F.col("id")) & (F.octet_length("body") == F.col("size"))
        & (F.xxhash64(F.substring("body", 1, PREFIX_CHARS)) == F.col("prefix"))
        & (F.col("digest").isNull() | (F.sha2("body", 256) == F.col("digest"))),
        "left_semi",
    )
    return kept.unionByName(again.dropDuplicates(["own", "body"]).select("row.*"))
