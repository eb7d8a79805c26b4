"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from staylens.catalog import load
from staylens.session import build_session

HEADLINE = [
    "q2_all_reviews", "q4_city_coverage", "q5_city_hotel_counts", "q6_city_review_counts",
    "q7_missing_reviews", "a5_distinct_locations", "a6_airport_cities", "j8_photo_targets_v2",
    "w2_top_cities", "m1_upsert_hotels", "m3_insert_reviews", "p7_parse_reviews_a",
    "p9_extract_cards", "p12_extract_text", "p19_parse_completions", "v1_chunk", "v3_embed",
    "v4_knn_dot", "v7_knn_filtered", "v8_ann_query", "v10_build_prompts", "v12_resolve_attempts",
    "v15_search_status", "a11_histogram_rollup", "t1_stream_new_reviews", "t2_stream_counters",
    "k5_export_embeddings",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}
    for name in HEADLINE:
        took = []
        # One warm-up, then the median of the timed runs.
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
