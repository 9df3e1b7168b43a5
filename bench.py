"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from aisle.session import local_session
from checks import QUERIES
from checks.base import Inputs

HEADLINE = (
    "generate_queries",
    "leave_one_out",
    "bm25_topk",
    "bm25_documents",
    "hybrid_topk",
    "retrieval_metrics",
    "popularity_recs",
    "itemcf_similarity_orders",
    "itemcf_recs",
    "negative_sampling",
    "vector_topk",
    "seq_markov_recs",
    "behavior_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").count()
    seconds = {}
    for name in HEADLINE:
        Inputs.forget(spark)
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
