"""Readers of landed text files, pages and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staylens.functions.text import trim_ws
from staylens.operators.windows import keep_last
from staylens.schemas import AIRPORT

# Fixed values of the landed files.
CITY_FILE = r"^(.*)Cities\.txt$"
NO_CONTINENT = "notdetected"
SKIPPED_COUNTRY = "KP"
REVIEW_PAGE_MARK = "reviews-"

# A control character that the landed files cannot contain as data.
_FIELD_END = "\u0001"


def quoted_fields(line: Column) -> Column:
    """Comma fields of a line; commas between quotes are data, quotes are dropped."""
    outside_quotes = F.transform(
        F.split(line, '"'),
        lambda part, i: F.when(i % 2 == 0, F.translate(part, ",", _FIELD_END)).otherwise(part),
    )
    fields = F.split(F.array_join(outside_quotes, ""), _FIELD_END)
    return F.transform(fields, trim_ws)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position: file, split, order inside the split."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
    )


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airports file; lines with fewer than 14 fields are dropped, extra fields ignored."""
    rows = _lines(spark, path).select(quoted_fields(F.col("value")).alias("f"), "pos")
    columns = [F.get("f", F.lit(i)).alias(name) for i, name in enumerate(AIRPORT.names)]
    return rows.filter(F.size("f") >= len(AIRPORT.names)).select(*columns, "pos")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Countries file: one row per two-letter code, the last line of a code wins."""
    rows = _lines(spark, path).select(quoted_fields(F.col("value")).alias("f"), "pos")
    named = rows.filter(F.size("f") >= 3).select(
        F.get("f", F.lit(0)).alias("name"),
        F.get("f", F.lit(1)).alias("iso2"),
        F.get("f", F.lit(2)).alias("alt_code"),
        "pos",
    )
    kept = keep_last(named.filter(F.col("iso2") != SKIPPED_COUNTRY), ["iso2"], ["pos"])
    codes = F.when(F.col("iso2") == F.col("alt_code"), F.col("iso2")).otherwise(
        F.concat_ws(",", "iso2", "alt_code")
    )
    return kept.select("name", "iso2", codes.alias("codes"))


def read_city_files(spark: SparkSession, folder: str) -> DataFrame:
    """``<continent>Cities.txt`` files; only lines with exactly two fields count."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder).select(
        F.split("value", ",").alias("f"), F.col("_metadata.file_name").alias("file")
    )
    continent = F.regexp_extract("file", CITY_FILE, 1)
    found = F.col("file").rlike(CITY_FILE)
    return lines.filter(F.size("f") == 2).select(
        F.col("f")[0].alias("name"),
        F.col("f")[1].alias("country"),
        F.when(found, continent).otherwise(NO_CONTINENT).alias("continent"),
    )


def read_saved_pages(spark: SparkSession, folder: str, reviews_only: bool = False) -> DataFrame:
    """Saved pages below a folder: path relative to it and the page text."""
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    pages = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.html")
        .text(folder, wholetext=True)
    )
    # File paths arrive URL-encoded; a plain plus sign must survive decoding.
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    out = pages.select(
        F.substring_index(full, root, -1).alias("path"), F.col("value").alias("html")
    )
    return out.filter(F.col("path").contains(REVIEW_PAGE_MARK)) if reviews_only else out


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per line; ``payload`` is NULL for broken documents."""
    return spark.read.text(path).select(
        F.col("value").alias("raw"), F.from_json("value", schema).alias("payload")
    )
