"""Parameter sweeps over BM25 settings with the configuration as a group key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.text import ITEM_TEXT_FIELDS, tokenize
from aisle.operators.matching import best_matches
from aisle.operators.retrieval import (
    distinct_texts,
    fill_with_zeros,
    query_terms,
)


def config_table(spark, configs: Sequence[Mapping]) -> DataFrame:
    """One row per configuration: name, k1, b and a weight per field (0 leaves a field out)."""
    rows = [
        (
            c["name"],
            float(c.get("k1", 1.5)),
            float(c.get("b", 0.75)),
            {
                f: (float(c.get("field_weights", {}).get(f, 1.0)) if f in c.get("fields", ITEM_TEXT_FIELDS) else 0.0)
                for f in ITEM_TEXT_FIELDS
            },
        )
        for c in configs
    ]
    return spark.createDataFrame(rows, "config_name string, k1 double, b double, weights map<string,double>")


def sweep_topk(items: DataFrame, queries: DataFrame, configs: DataFrame, k: int = 50) -> DataFrame:
    """(config_name, query_text, item_id, score, rank) for every configuration in one job.

    Tokens are counted per field once; a configuration only re-weights the counts. The
    configuration list is a handful of rows and is broadcast.
    """
    texts = distinct_texts(queries)
    fields = [_field_tokens(f) for f in ITEM_TEXT_FIELDS]
    counted = (
        items.select("item_id", *ITEM_TEXT_FIELDS)
        .repartition("item_id")
        .select("item_id", F.explode(F.concat(*fields)).alias("x"))
        .groupBy("item_id", F.col("x.term").alias("term"), F.col("x.f").alias("f"))
        .agg(F.count("*").alias("n"))
    )
    weighted = (
        counted.join(F.broadcast(configs))
        .withColumn("w", F.col("weights")[F.col("f")])
        .where(F.col("w") > 0)
        .groupBy("item_id", "config_name", "k1", "b", "term")
        .agg(F.sum(F.col("n") * F.col("w")).alias("tf"))
    )
    total = items.agg(F.count("*").cast("double")).scalar()
    means = weighted.groupBy("config_name").agg((F.sum("tf") / total).alias("avgdl"))
    df = F.col("df").cast("double")
    idf = (
        weighted.groupBy("config_name", "term")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(F.lit(1.0) + (total - df + 0.5) / (df + 0.5)))
    )
    asked = query_terms(texts)
    wanted = asked.join(idf, "term").select(
        "query_text", "config_name", "term", (F.col("tf") * F.col("idf")).alias("weight")
    )
    length = F.sum("tf").over(Window.partitionBy("item_id", "config_name"))
    share = F.col("dl") / F.col("avgdl")
    postings = (
        weighted.withColumn("dl", length)
        .join(F.broadcast(means), "config_name")
        .select(
            "config_name",
            "item_id",
            "term",
            (
                F.col("tf") * (F.col("k1") + 1)
                / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * share))
            ).alias("weight"),
        )
    )
    key = ["config_name", "query_text"]
    top = best_matches(postings, wanted, k, items.count(), ["config_name"])
    every = texts.join(F.broadcast(configs.select("config_name")))
    return fill_with_zeros(top, every, items.select("item_id"), k, ["score"], key)


def _field_tokens(name: str):
    tokens = F.coalesce(tokenize(F.col(name).cast("string")), F.array().cast("array<string>"))
    return F.transform(tokens, lambda t: F.struct(F.lit(name).alias("f"), t.alias("term")))


def sweep_per_query(results: DataFrame, pairs: DataFrame, k_values: Sequence[int] = (3, 5, 10, 50)) -> DataFrame:
    """Per (config, query): target rank (0 when missing), recall and MRR, with the query type."""
    hits = results.select(
        "config_name", "query_text", F.col("item_id").alias("target_item_id"), F.col("rank").alias("_r")
    )
    names = results.select("config_name").distinct()
    queries = pairs.select("query_id", "query_text", "target_item_id", F.col("source").alias("query_type"))
    every = queries.join(F.broadcast(names))
    hits = F.broadcast(hits) if skew.fits_broadcast(hits) else hits
    joined = every.join(hits, ["config_name", "query_text", "target_item_id"], "left")
    rank = F.col("_r")
    return joined.select(
        "config_name",
        "query_id",
        "query_text",
        "query_type",
        "target_item_id",
        F.coalesce(rank, F.lit(0)).alias("target_rank"),
        *[F.when(rank <= k, 1.0).otherwise(0.0).alias(f"recall_at_{k}") for k in k_values],
        *[F.when(rank <= k, 1.0 / rank).otherwise(0.0).alias(f"mrr_at_{k}") for k in k_values],
    )


def sweep_summary(per_query: DataFrame) -> DataFrame:
    metrics = [c for c in per_query.columns if c.startswith(("recall_at_", "mrr_at_"))]
    return per_query.groupBy("config_name").agg(
        F.count("*").alias("num_queries"), *[F.avg(c).alias(c) for c in metrics]
    )
