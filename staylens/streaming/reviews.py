"""Incremental insert-if-absent of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from staylens.operators.merges import with_review_key
from staylens.operators.windows import first_per_key

KEY = ["source", "source_review_id"]
#: Folders of the target by key hash; a batch reads only those its keys fall in.
BUCKETS = 64


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))


def stream_new_reviews(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append reviews of new keys to the table at ``target``, however old they are.

    The stored keys are the only state: each batch keeps one review per key, the
    oldest, and joins the rest away against the stored keys of its buckets. A
    batch is stored in its own ``batch`` folder and replaced when it is run
    again, so a lost executor or a restart repeats no row.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        stored = spark.read.schema(f"{schema.toDDL()}, batch bigint, bucket int").parquet(target)
        batch = bucketed(first_per_key(batch, KEY, [F.asc("review_date")])).persist()
        hit = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        keys = stored.filter((F.col("batch") != batch_id) & F.col("bucket").isin(hit)).select(*KEY)
        # The small batch picks its known keys out of the large table first.
        known = keys.join(batch.select(*KEY), KEY, "left_semi")
        fresh = batch.join(known, KEY, "left_anti").select(*schema.names, "bucket")
        # Each bucket in one task, so that a batch adds a file per bucket and not one per bucket and task.
        fresh = fresh.repartition("bucket")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")
        batch.unpersist()

    # The target must exist before the first batch reads it.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/batch=-1/bucket=0")
    return (
        with_review_key(stream)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
