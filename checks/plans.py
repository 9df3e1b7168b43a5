"""Queries of the evaluation plans: methods by name, stored results, sweeps over methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import tuning
from aisle.plans import evaluate as ev
from aisle.plans.rankers import build_ranker
from aisle.session import scratch_dir
from checks.base import Inputs, check, cte
from checks.evaluation import SUMMARY, SWEEP_K, _target_metrics
from checks.ranking import candidate_frame, rounded

TOPS = {"bm25": "bm25_top", "dense": "tfidf_top", "hybrid": "hybrid_top"}


def _evaluated(method: str, split: str, path: str) -> str:
    return f"""SELECT '{method}' AS method, '{path}' AS config_path, '{split}' AS split, count(*) AS num_queries,
 count(f.query_text)::DOUBLE / count(*) AS query_coverage, {_target_metrics((10, 20, 50), rank="t.rank")}
FROM pairs p LEFT JOIN {TOPS[method]} t ON t.query_text = p.query_text AND t.item_id = p.target_item_id
LEFT JOIN (SELECT DISTINCT query_text FROM {TOPS[method]}) f ON f.query_text = p.query_text WHERE p.split = '{split}'"""


@check(
    "evaluate_retrieval",
    " UNION ALL ".join(_evaluated(m, s, p) for m, s, p in (("dense", "test", "a"), ("bm25", "test", "b"), ("bm25", "val", "b"))),
    "pairs", "bm25_top", "tfidf_top",
)
def evaluate_retrieval(spark, sf):
    """Three runs are stored, one of them twice: the later row takes the place of the earlier one."""
    x = Inputs(spark, sf)
    root = scratch_dir(spark, "results")
    stored = None
    for method, split, path in (("bm25", "test", "b"), ("dense", "test", "a"), ("bm25", "val", "b")):
        row = rounded(ev.evaluate_retrieval(method, x.items, x.pairs, split, config_path=path))
        if stored is None:
            ev.record_results(row.withColumn("num_queries", F.lit(-1).cast("long")), root)
        stored = ev.record_results(row, root)
    return stored


cte("mixed_test", "SELECT *, model_rank AS r FROM mixed WHERE split = 'test'", "mixed")


@check(
    "evaluate_ranker",
    f"""SELECT 'mixed' AS method, 'c' AS config_path, '' AS model_path, 20 AS top_k, m.*, a.auc FROM (
SELECT split, count(*) AS num_queries, round(avg(covered), 6) AS candidate_coverage,
 {_target_metrics((10, 20), ("ndcg", "mrr"), "r")},
 round(avg(CASE WHEN r <= 10 THEN 0.1e0 ELSE 0 END), 6) AS precision_at_10,
 round(avg(CASE WHEN r <= 20 THEN 0.05e0 ELSE 0 END), 6) AS precision_at_20,
 {_target_metrics((10, 20), ("recall",), "r")}
FROM (SELECT split, query_id, max(label)::DOUBLE AS covered, min(CASE WHEN label = 1 THEN r END) AS r FROM mixed_test GROUP BY 1, 2)
GROUP BY 1) m, (SELECT round((sum(CASE WHEN label = 1 THEN mean_rank END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM (
 SELECT label, rank() OVER (ORDER BY model_score) + (count(*) OVER (PARTITION BY model_score) - 1) / 2e0 AS mean_rank,
  sum(label) OVER () AS p, count(*) OVER () AS n FROM mixed_test) GROUP BY p, n) a""",
    "mixed_test",
)
def evaluate_ranker(spark, sf):
    candidates = candidate_frame(spark, sf)
    return rounded(ev.evaluate_ranker(build_ranker("mixed", candidates), candidates, config_path="c"))


@check(
    "sweep_retrievers",
    SUMMARY.replace("sweep_pq", "(" + " UNION ALL ".join(
        f"""SELECT '{name}' AS config_name, coalesce(rank, 0) AS target_rank FROM pairs p LEFT JOIN {top} t
 ON t.query_text = p.query_text AND t.item_id = p.target_item_id""" for name, top in TOPS.items()
    ) + ")"),
    "pairs", *TOPS.values(),
)
def sweep_retrievers(spark, sf):
    x = Inputs(spark, sf)
    configs = [{"name": name, "method": name} for name in TOPS]
    found = ev.sweep_retrievers(configs, x.items, x.pairs, 50)
    return rounded(tuning.sweep_summary(tuning.sweep_per_query(found, x.pairs, SWEEP_K)))
