"""Vector columns: normalising, non-empty test, the offline embedder."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions.text import words


def has_vector(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def l2_normalise(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Scale every vector to length one; zero vectors stay zero."""
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_unit")
    out = unit.transform(df.withColumn("_v", array_to_vector(F.col(col))))
    return out.withColumn(col, vector_to_array("_unit")).drop("_v", "_unit")


def mean_vectors(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """Mean vector per key, combined map-side."""
    mean = Summarizer.mean(array_to_vector(F.col(col)))
    return df.groupBy(key).agg(vector_to_array(mean).alias(col))


class HashingEmbedder:
    """Deterministic bag-of-words embedder for offline runs, on columns.

    Word counts go to ``md5(word) mod dim`` and the result has length one; a
    null text or one without words has the zero vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        # Of the first eight digits only the last ones count where their number of values is a multiple of the dimension.
        digits = next((n for n in range(1, 8) if 16**n % self.dim == 0), 8)
        code = lambda w: F.conv(F.substring(F.md5(w), 9 - digits, digits), 16, 10).cast("long")
        bucket = F.transform(
            words(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: (code(w) % self.dim).cast("string"))
        counts = CountVectorizerModel.from_vocabulary(
            [str(i) for i in range(self.dim)], inputCol="_buckets", outputCol="_counts")
        unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit")
        found = unit.transform(counts.transform(df.withColumn("_buckets", bucket)))
        return found.withColumn(out, vector_to_array("_unit")).drop("_buckets", "_counts", "_unit")


def hashing_embedder(dim: int = 64) -> HashingEmbedder:
    return HashingEmbedder(dim)
