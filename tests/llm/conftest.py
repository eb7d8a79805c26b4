"""Small inputs that the tests of this folder share."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, first=0):
        rows = [(first + i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """Documents with columns named like the operators' own."""

    def make(texts):
        from pyspark.sql import functions as F

        names = ["id", "body", "size", "digest", "n", "key", "keys", "rep", "component_id", "bits", "slice", "label"]
        return docs(texts).withColumns({c: F.lit("x") for c in names})

    return make
