"""Evaluate named methods, and keep their results as versions of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.operators import metrics
from aisle.plans.rankers import Ranker
from aisle.plans.retrievers import build_retriever
from aisle.session import cut_lineage
from aisle.sources.files import upsert_results, write_version

# What names a run among stored results.
RUN_KEYS = ("method", "split", "config_path")


def _of_split(df: DataFrame, split: str, what: str) -> DataFrame:
    part = df.where(F.col("split") == split)
    if part.isEmpty():
        raise ValueError(f"no {what} for split={split}")
    return part


def _named(summary: DataFrame, method: str, config_path: str, **more) -> DataFrame:
    names = {"method": method, "config_path": config_path, **more}
    return summary.select(*[F.lit(v).alias(k) for k, v in names.items()], *summary.columns)


def evaluate_retrieval(
    method: str,
    items: DataFrame,
    pairs: DataFrame,
    split: str = "test",
    k_values: Sequence[int] = (10, 20, 50),
    top_k: int | None = None,
    config_path: str = "",
    **settings,
) -> DataFrame:
    """One row of retrieval metrics of the named method for the pairs of a split.

    ``settings`` go to the method's index or search. A split without pairs is an error.
    """
    asked = _of_split(pairs, split, "query-item pairs")
    found = build_retriever(method, items, **settings)(asked, top_k or max(k_values))
    per_query = metrics.retrieval_per_query(found, asked, k_values)
    return _named(cut_lineage(metrics.retrieval_metrics(per_query)), method, config_path)


def evaluate_ranker(
    ranker: Ranker,
    candidates: DataFrame,
    split: str = "test",
    k_values: Sequence[int] = (10, 20),
    top_k: int | None = None,
    config_path: str = "",
    model_path: str = "",
) -> DataFrame:
    """One row of ranking metrics with the AUC of a fitted method for the candidates of a split."""
    scored = cut_lineage(
        ranker.score(_of_split(candidates, split, "candidates")).select(
            "split", "query_id", "candidate_item_id", "label", "model_score"
        )
    )
    summary = metrics.ranking_metrics(scored, ["split"], k_values)
    both = summary.join(metrics.auc(scored, ["split"], "model_score"), "split")
    return _named(both, ranker.method, config_path, model_path=model_path, top_k=top_k or max(k_values))


def _versions(spark: SparkSession, root: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def stored_results(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest whole version of the results below ``root``, or None."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/version={versions[-1]:06d}") if versions else None


def record_results(new: DataFrame, root: str, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Puts ``new`` in place of stored rows of the same run and returns all results.

    A new version is written beside the last one, so a lost writer leaves the stored results whole.
    Columns that only one side has are null in the other's rows.
    """
    spark = new.sparkSession
    versions = _versions(spark, root)
    before = stored_results(spark, root)
    merged = new if before is None else upsert_results(before, new, keys)
    number = versions[-1] + 1 if versions else 0
    while True:
        try:
            return spark.read.parquet(write_version(merged, root, number))
        except AnalysisException as error:
            # a version that a lost writer left without its end
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            number += 1


def sweep_retrievers(
    configs: Sequence[Mapping], items: DataFrame, queries: DataFrame, k: int = 50
) -> DataFrame:
    """``config_name, query_text, item_id, rank`` of every configuration, for any retrieval method.

    A configuration has a ``name``, a ``method`` and the ``settings`` of that method. Each distinct
    text is searched once per configuration; the lists serve ``aisle.operators.tuning`` and the
    comparison reports like those of its BM25 sweep.
    """
    if len({c["name"] for c in configs}) < len(configs) or not configs:
        raise ValueError("configurations need names of their own")
    texts = cut_lineage(queries.where("query_text is not null").select("query_text").distinct())
    asked = texts.withColumn("query_id", F.col("query_text"))
    found = None
    for config in configs:
        search = build_retriever(config["method"], items, **config.get("settings", {}))
        part = search(asked, k).select(
            F.lit(config["name"]).alias("config_name"), F.col("query_id").alias("query_text"), "item_id", "rank"
        )
        found = part if found is None else found.unionByName(part)
    return found
