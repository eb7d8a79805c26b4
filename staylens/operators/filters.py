"""Projections, predicates and the search-form rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from staylens.functions.text import contains_yes, parse_int, trim_ws
from staylens.functions.vectors import has_vector

# Fixed values of the search form and the safety gate.
LOW_COUNT = 50
RESUME_CURSOR = "ta_633460"
AUTO_MODEL = "auto"
UNSAFE_MESSAGE = (
    "Your query was flagged as not relevant to hotel reviews. Please try a different question."
)


def with_provenance(df: DataFrame, label: str) -> DataFrame:
    """Hotel columns under model names plus the table they came from."""
    return df.select(
        "source_hotel_id", F.col("name").alias("hotel_name"), "street_address", "city",
        "country", "source", F.lit(label).alias("table_source"),
    )


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to a schema; columns the input lacks become typed NULLs."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def non_null_text(df: DataFrame, col: str = "review_text") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def hotels_after(df: DataFrame, source: str = "", cursor: str = RESUME_CURSOR) -> DataFrame:
    """Hotels of a source past a resume cursor; no source means all hotels."""
    if source:
        df = df.filter((F.col("source") == source) & (F.col("hotel_id") > cursor))
    return df.orderBy("hotel_id")


def hotel_by_key(df: DataFrame, hotel_id: str) -> DataFrame:
    return df.filter(F.col("hotel_id") == hotel_id).orderBy("id").limit(1)


def hotels_in_city(df: DataFrame, city: str, country: str) -> DataFrame:
    inside = (F.col("city") == city) & (F.col("country") == country)
    return df.filter(inside).select("hotel_id", "name", "city", "country")


def non_empty(*cols: str) -> Column:
    """All columns present and not the empty string."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in cols])


def review_texts(df: DataFrame, hotel_id: str | None = None) -> DataFrame:
    """Texts with at least one visible character; those of one hotel come newest first."""
    seen = df.filter(F.length(trim_ws(F.col("review_text"))) > 0)
    if hotel_id is not None:
        newest = [F.desc("review_date"), F.desc("created_at")]
        seen = seen.filter(F.col("hotel_id") == hotel_id).orderBy(*newest)
    return seen.select("review_text")


def hotel_ids(df: DataFrame) -> DataFrame:
    return df.select("hotel_id")


def coverage_flags(df: DataFrame, n: int = LOW_COUNT) -> DataFrame:
    """Counts with NULL as zero, and the zero / low flags on them."""
    reviews = F.coalesce("review_count", F.lit(0))
    hotels = F.coalesce("hotel_count", F.lit(0))
    return df.withColumns(
        {
            "review_count": reviews,
            "hotel_count": hotels,
            "zero_reviews": reviews == 0,
            "low_reviews": reviews < n,
            "zero_hotels": hotels == 0,
            "low_hotels": hotels < n,
        }
    )


def _key(continent: Column | None, city: Column | None, country: Column | None) -> Column:
    """Text of a restrict key; a part that is left open admits all."""
    parts = [F.lit("*") if c is None else F.concat(F.lit("="), c) for c in (continent, city, country)]
    return F.concat(*[F.concat(p, F.lit("\x1e")) for p in parts])


def admitted_keys(item: dict[str, Column]) -> Column:
    """The restrict keys an item is admitted by: each part its own or open; a null part only open."""
    continent, city, country = (item[c] for c in ("continent", "city", "country"))
    keys = [_key(None, None, None)]
    placed = city.isNotNull() & country.isNotNull()
    keys.append(F.when(continent.isNotNull(), _key(continent, None, None)))
    keys.append(F.when(placed, _key(None, city, country)))
    keys.append(F.when(continent.isNotNull() & placed, _key(continent, city, country)))
    return F.array_compact(F.array(*keys))


def restrict_key(query: dict[str, Column]) -> Column:
    """The one restrict key a query asks for; a null key, asked by a null place, admits nothing."""
    anywhere = query["continent"].isNull() | (query["continent"] == "")
    city, country = query["city"], query["country"]
    return F.when(
        query["filter_city_country"],
        F.when(anywhere, F.when(city.isNotNull() & country.isNotNull(), _key(None, city, country)))
        .when(city.isNotNull() & country.isNotNull(), _key(query["continent"], city, country)),
    ).when(anywhere, _key(None, None, None)).otherwise(_key(query["continent"], None, None))


def normalise_queries(df: DataFrame, question: str, model: str) -> DataFrame:
    """Search form fields to search input: defaults, trimming, flags."""
    stars = parse_int(trim_ws(F.col("rating")))
    wanted = F.lower(trim_ws(F.col("llm")))
    parts = F.split(trim_ws(F.col("citycountry")), ",")
    paired = F.coalesce(F.size(parts) >= 2, F.lit(False))
    rated = F.coalesce(stars > 0, F.lit(False))
    blank = F.coalesce(F.col("question"), F.lit("")) == ""
    no_model = F.coalesce(F.col("llm") == "", F.lit(True)) | (wanted == AUTO_MODEL)
    return df.select(
        "query_id",
        F.when(blank, F.lit(question)).otherwise(trim_ws(F.col("question"))).alias("question"),
        F.coalesce(trim_ws(F.col("continent")), F.lit("")).alias("continent"),
        F.when(paired, trim_ws(F.get(parts, F.lit(0)))).otherwise("").alias("city"),
        F.when(paired, trim_ws(F.get(parts, F.lit(1)))).otherwise("").alias("country"),
        F.when(rated, stars).otherwise(F.lit(0)).cast("int").alias("rating"),
        rated.alias("filter_rating"),
        paired.alias("filter_city_country"),
        F.when(no_model, F.lit(model)).otherwise(F.col("llm")).alias("preferred_model"),
    )


def valid_airports(df: DataFrame) -> DataFrame:
    """Passenger airports with a real three-letter code and a city."""
    code = F.col("iata")
    return df.filter(
        (code != r"\N") & (F.length(code) == 3) & (F.col("city") != "")
        & (F.col("type") == "airport")
    )


def safety_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("safe", contains_yes(F.col("answer")))


def apply_safety(df: DataFrame) -> DataFrame:
    """Unsafe queries lose their answer and carry the fixed message."""
    return df.withColumns(
        {
            "content": F.when(F.col("safe"), F.col("content")),
            "message": F.when(F.col("safe"), F.lit("")).otherwise(F.lit(UNSAFE_MESSAGE)),
        }
    )


def non_empty_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.filter(has_vector(F.col(col)))
