"""Writers, staging files and index exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from staylens.functions.vectors import has_vector
from staylens.operators.windows import keep_last


def append(df: DataFrame, path: str, batch: int = 0) -> None:
    """Append rows; ``batch`` limits rows per file (0 leaves file sizes to Spark)."""
    df.write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def create_if_absent(spark: SparkSession, schema: StructType, path: str) -> None:
    """Empty table of a schema; an existing one is left alone."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def overwrite(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    """Replace a table by rows cast to an explicit schema."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    df.write.mode("overwrite").parquet(path)


def stage_jsonl(df: DataFrame, folder: str) -> None:
    """Gzip JSON lines, one file per task."""
    df.write.mode("overwrite").option("compression", "gzip").json(folder)


def load_jsonl(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Staged lines; invalid lines are skipped and unknown fields ignored."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def export_embeddings(df: DataFrame, metadata: list[str], id_col: str = "id") -> DataFrame:
    """Rows of the vector index load: string id, vector, metadata as JSON."""
    return df.filter(has_vector(F.col("embedding"))).select(
        F.col(id_col).cast("string").alias("id"),
        "embedding",
        F.to_json(F.struct(*metadata)).alias("rest_metadata"),
    )


def build_datapoints(df: DataFrame, tokens: list[str], numbers: list[str],
                     metadata: list[str]) -> DataFrame:
    """Index datapoints: vector, token restricts, numeric restricts, metadata."""

    def token(name: str) -> Column:
        return F.struct(F.lit(name).alias("namespace"), F.array(name).alias("allow_list"))

    def number(name: str) -> Column:
        return F.struct(F.lit(name).alias("namespace"), F.col(name).cast("double").alias("value"))

    return df.filter(has_vector(F.col("embedding"))).select(
        F.col("id").cast("string").alias("datapoint_id"),
        F.col("embedding").alias("feature_vector"),
        F.array(*[token(t) for t in tokens]).alias("restricts"),
        F.array(*[number(n) for n in numbers]).alias("numeric_restricts"),
        F.struct(*metadata).alias("metadata"),
    )


def upsert_vectors(base: DataFrame, delta: DataFrame, pos: str, key: str = "id") -> DataFrame:
    """Replace or add vectors by id; the last delta row of an id wins."""
    newest = keep_last(delta, [key], [pos]).drop(pos)
    return base.join(newest.select(key), key, "left_anti").unionByName(newest)


def materialise(df: DataFrame, name: str, kind: str = "view") -> None:
    """Publish a model as a view or as a replaced table."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        df.write.mode("overwrite").saveAsTable(name)
    else:
        raise ValueError(f"unknown kind: {kind}")
