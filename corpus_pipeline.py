"""Training-corpus pipeline over ``documents``: toxicity, exact copies, near copies, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from staylens.llm.common import table, written
from staylens.llm.queries import TOKENIZER, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the given tables."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return toxicity.score(docs, net, carry=rest, keep_text=True).where("predicted = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest id, of each group connected by a Jaccard similarity of 0.8 over five words."""
    return jaccard_join.keep_one(docs, shingle=5, num=4, den=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secret_scan.redact(docs, path_col="source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

# Models and tokenizers cannot be written in SQL; the pipeline is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows between two stages are stored once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
