"""Offline metrics as aggregations over ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators.quantiles import exact_quantile
from aisle.session import cut_lineage, keep_columns


def _latency(df: DataFrame) -> list[Column]:
    if "latency_ms" not in df.columns:
        return []
    return [F.avg("latency_ms").alias("avg_latency_ms")]


def _with_p95(summary: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``summary`` (one row per group) with the 95th percentile of the rows' latency."""
    if "latency_ms" not in rows.columns:
        return summary
    found = exact_quantile(rows, "latency_ms", 0.95, by, "p95_latency_ms")
    if not by:
        return summary.join(found, how="left")
    same = [summary[c].eqNullSafe(found[c]) for c in by]
    return summary.join(found, same, "left").drop(*[found[c] for c in by])


def _rank_columns(rank: Column, k_values: Sequence[int], names: Sequence[str]) -> list[Column]:
    """recall, mrr and ndcg at k of a single target found at ``rank`` (null when missing)."""
    makers = {
        "recall": lambda k: F.when(rank <= k, 1.0).otherwise(0.0),
        "mrr": lambda k: F.when(rank <= k, 1.0 / rank).otherwise(0.0),
        "ndcg": lambda k: F.when(rank <= k, 1.0 / F.log2(rank + 1)).otherwise(0.0),
    }
    return [makers[n](k).alias(f"{n}_at_{k}") for n in names for k in k_values]


def target_ranks(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with ``target_rank`` (null when missing) and the number of results of their query."""
    hits = results.select(
        "query_id", F.col("item_id").alias("target_item_id"), F.col("rank").alias("target_rank")
    )
    sizes = results.groupBy("query_id").agg(F.count("*").alias("num_results"))
    # only pairs whose target is listed for some query can have a hit; few of them reach all results unmoved
    listed = hits.select("target_item_id").distinct()
    able = pairs.select("query_id", "target_item_id").join(listed, "target_item_id", "left_semi")
    able = cut_lineage(able.limit(skew.BROADCAST_ROWS + 1))
    if able.count() <= skew.BROADCAST_ROWS:
        hits = F.broadcast(hits.join(F.broadcast(able), ["query_id", "target_item_id"], "left_semi"))
    return (
        pairs.join(hits, ["query_id", "target_item_id"], "left")
        .join(sizes, "query_id", "left")
        .withColumn("num_results", F.coalesce("num_results", F.lit(0)))
    )


def retrieval_per_query(
    results: DataFrame, pairs: DataFrame, k_values: Sequence[int] = (10, 20, 50)
) -> DataFrame:
    found = target_ranks(results, pairs)
    rank = F.col("target_rank")
    keep = [c for c in pairs.columns if c not in ("target_rank", "num_results")]
    return found.select(
        *keep,
        "num_results",
        (F.col("num_results") > 0).alias("has_results"),
        F.coalesce(rank, F.lit(0)).alias("target_rank"),
        *_rank_columns(rank, k_values, ("recall", "mrr")),
    )


def _means(df: DataFrame, prefixes: Sequence[str]) -> list[Column]:
    return [F.avg(c).alias(c) for c in df.columns if c.startswith(tuple(prefixes))]


def retrieval_metrics(per_query: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Means over queries, query coverage and latency per group."""
    summary = per_query.groupBy(*by).agg(
        F.count("*").alias("num_queries"),
        F.avg(F.col("has_results").cast("double")).alias("query_coverage"),
        *_means(per_query, ("recall_at_", "mrr_at_")),
        *_latency(per_query),
    )
    return _with_p95(summary, per_query, by)


def _ideal_dcg(count: Column, k: int) -> Column:
    """DCG of ``count`` relevant items in front, looked up in the k partial sums."""
    import math

    sums, total = [], 0.0
    for place in range(1, k + 1):
        total += 1.0 / math.log2(place + 1)
        sums.append(total)
    table = F.array(*[F.lit(x) for x in sums])
    return F.element_at(table, F.least(count, F.lit(k)).cast("int"))


def reco_per_user(recs: DataFrame, targets: DataFrame, k_values: Sequence[int] = (10, 20)) -> DataFrame:
    """hit rate, recall, NDCG and MRR per user with distinct target items."""
    wanted = targets.where("item_id is not null").select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count("*").alias("num_targets"))
    hits = recs.join(wanted, ["user_id", "item_id"], "left_semi")
    aggregates = []
    for k in k_values:
        within = F.col("rank") <= k
        gain = F.when(within, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
        aggregates += [
            F.count_if(within).alias(f"_hits_{k}"),
            F.sum(gain).alias(f"_dcg_{k}"),
            F.min(F.when(within, F.col("rank"))).alias(f"_first_{k}"),
        ]
    found = hits.groupBy("user_id").agg(*aggregates)
    shown = recs.groupBy("user_id").agg(F.count("*").alias("num_recommendations"))
    joined = sizes.join(found, "user_id", "left").join(shown, "user_id", "left")
    zero = F.lit(0)
    columns: list[Column] = [
        F.col("user_id"),
        F.col("num_targets"),
        F.coalesce("num_recommendations", zero).alias("num_recommendations"),
    ]
    for k in k_values:
        count = F.coalesce(f"_hits_{k}", zero)
        columns += [
            F.when(count > 0, 1.0).otherwise(0.0).alias(f"hit_rate_at_{k}"),
            (count / F.col("num_targets")).alias(f"recall_at_{k}"),
            (F.coalesce(f"_dcg_{k}", F.lit(0.0)) / _ideal_dcg(F.col("num_targets"), k)).alias(
                f"ndcg_at_{k}"
            ),
            F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
        ]
    return joined.select(*columns)


def coverage(recs: DataFrame, catalog: DataFrame, k_values: Sequence[int], name: str = "coverage") -> DataFrame:
    """One row: share of catalog items that appear in some list within k.

    Distinct items are reduced to their best rank first, so the count is over items, not lists.
    """
    best = recs.groupBy("item_id").agg(F.min("rank").alias("rank"))
    size = catalog.agg(F.greatest(F.countDistinct("item_id"), F.lit(1))).scalar()
    return best.agg(
        *[(F.count_if(F.col("rank") <= k) / size).alias(f"{name}_at_{k}") for k in k_values]
    )


def reco_metrics(
    recs: DataFrame, targets: DataFrame, catalog: DataFrame, k_values: Sequence[int] = (10, 20)
) -> DataFrame:
    """One summary row: means over users and catalog coverage of the evaluated users' lists."""
    per_user = reco_per_user(recs, targets, k_values)
    shown = recs.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    means = per_user.agg(
        F.count("*").alias("num_users"),
        *_means(per_user, ("hit_rate_at_", "recall_at_", "ndcg_at_", "mrr_at_")),
    )
    covered = coverage(shown, catalog, k_values)
    return means.join(F.broadcast(covered))


def ranking_per_query(
    scored: DataFrame,
    k_values: Sequence[int] = (10, 20),
    score: str = "model_score",
    by: Sequence[str] = (),
) -> DataFrame:
    """DCG-based and counting metrics of scored candidate lists, per query."""
    key = [*by, "query_id"]
    shown = Window.partitionBy(*key).orderBy(F.col(score).desc(), "candidate_item_id")
    ideal = Window.partitionBy(*key).orderBy(F.col("label").desc(), "candidate_item_id")
    placed = scored.select(*key, "candidate_item_id", "label", score).withColumns(
        {"_r": F.row_number().over(shown), "_i": F.row_number().over(ideal)}
    )
    label = F.col("label").cast("double")
    aggregates = [
        F.count("*").alias("num_candidates"),
        F.sum("label").cast("long").alias("num_relevant"),
        F.max(F.when(F.col("label") > 0, 1.0).otherwise(0.0)).alias("candidate_covered"),
    ]
    for k in k_values:
        within = F.col("_r") <= k
        aggregates += [
            F.sum(F.when(within, label / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias(f"_dcg_{k}"),
            F.sum(F.when(F.col("_i") <= k, label / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias(
                f"_idcg_{k}"
            ),
            F.min(F.when(within & (F.col("label") > 0), F.col("_r"))).alias(f"_first_{k}"),
            F.sum(F.when(within, label).otherwise(0.0)).alias(f"_hits_{k}"),
        ]
    summed = placed.groupBy(*key).agg(*aggregates)
    columns: list = [*key, "num_candidates", "num_relevant", "candidate_covered"]
    for k in k_values:
        hits, ideal_dcg = F.col(f"_hits_{k}"), F.col(f"_idcg_{k}")
        relevant = F.col("num_relevant")
        columns += [
            F.when(ideal_dcg > 0, F.col(f"_dcg_{k}") / ideal_dcg).otherwise(0.0).alias(f"ndcg_at_{k}"),
            F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
            (hits / k).alias(f"precision_at_{k}"),
            F.when(relevant > 0, hits / relevant).otherwise(0.0).alias(f"recall_at_{k}"),
        ]
    return summed.select(*columns)


def ranking_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    k_values: Sequence[int] = (10, 20),
    score: str = "model_score",
) -> DataFrame:
    per_query = ranking_per_query(scored, k_values, score, by)
    return per_query.groupBy(*by).agg(
        F.count("*").alias("num_queries"),
        F.avg("candidate_covered").alias("candidate_coverage"),
        *_means(per_query, ("ndcg_at_", "mrr_at_", "precision_at_", "recall_at_")),
    )


def auc(scored: DataFrame, by: Sequence[str] = (), score: str = "model_score") -> DataFrame:
    """Area under the curve per group, null when a group has one class only.

    Equal scores share the mean of their places, so ties get half credit and no pair of a positive with
    a negative is ever formed. Rows are counted per score before anything moves; places are running sums of
    these counts inside ranges of scores, so no group passes through one task.
    """
    keys = list(by)
    positive = F.col("label") > 0
    counts = scored.groupBy(*keys, score).agg(
        F.count("*").alias("_n"), F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q")
    )
    ranges = cut_lineage(counts.repartitionByRange(*keys, score).withColumn("_range", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_n"))
        .select(
            *[F.col(c).alias(f"_of_{c}") for c in keys],
            F.col("_range").alias("_of"),
            F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]]
    placed = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        F.broadcast(offsets), same
    )
    mean = F.col("_offset") + F.col("_before") + (F.col("_n") + 1) / 2.0
    p, q = F.sum("_p").cast("double"), F.sum("_q").cast("double")
    ranks = F.sum(mean * F.col("_p"))
    value = F.when((p > 0) & (q > 0), (ranks - p * (p + 1) / 2) / (p * q))
    return placed.groupBy(*keys).agg(value.alias("auc"))


def representation_per_query(
    results: DataFrame, pairs: DataFrame, cold: DataFrame, k_values: Sequence[int] = (10, 20)
) -> DataFrame:
    """Single-target metrics; cold-start recall is null unless the target is a cold item."""
    flags = cold.select(F.col("item_id").alias("target_item_id"), F.lit(True).alias("_cold"))
    found = target_ranks(results, pairs).join(flags, "target_item_id", "left")
    rank, is_cold = F.col("target_rank"), F.coalesce("_cold", F.lit(False))
    recall = {k: F.when(rank <= k, 1.0).otherwise(0.0) for k in k_values}
    return found.select(
        "query_id",
        "split",
        "target_item_id",
        is_cold.alias("is_cold_start_target"),
        *_rank_columns(rank, k_values, ("recall", "ndcg", "mrr")),
        *[F.when(is_cold, recall[k]).alias(f"cold_start_recall_at_{k}") for k in k_values],
    )


def category_diversity(
    results: DataFrame, items: DataFrame, k_values: Sequence[int]
) -> DataFrame:
    """One row: mean distinct categories per list over min(k, number of categories)."""
    categories = items.where("category <> ''").select("item_id", "category")
    available = categories.agg(F.countDistinct("category")).scalar()
    best = (
        skew.join_named(
            results.select("query_id", "item_id", "rank"), categories, "item_id", "left", row_id=["query_id"]
        )
        .groupBy("query_id", "category")
        .agg(F.min("rank").alias("rank"))
    )
    counted = best.groupBy("query_id").agg(
        *[
            F.count_if((F.col("rank") <= k) & F.col("category").isNotNull()).alias(f"_n_{k}")
            for k in k_values
        ]
    )
    shares = [
        F.avg(F.col(f"_n_{k}") / F.greatest(F.lit(1), F.least(F.lit(k), available))).alias(
            f"category_diversity_at_{k}"
        )
        for k in k_values
    ]
    return counted.agg(*shares)


def representation_metrics(
    results: DataFrame,
    pairs: DataFrame,
    items: DataFrame,
    cold: DataFrame,
    long_tail: DataFrame,
    k_values: Sequence[int] = (10, 20),
) -> DataFrame:
    per_query = representation_per_query(results, pairs, cold, k_values)
    prefixes = ("recall_at_", "ndcg_at_", "mrr_at_", "cold_start_recall_at_")
    means = per_query.agg(F.count("*").alias("num_queries"), *_means(per_query, prefixes))
    shown = results.select("query_id", "item_id", "rank").join(pairs.select("query_id"), "query_id", "left_semi")
    shown = keep_columns(shown, "shown")
    best = cut_lineage(shown.groupBy("item_id").agg(F.min("rank").alias("rank")))
    tail = best.join(long_tail.select("item_id"), "item_id", "left_semi")
    parts = (
        coverage(best, items, k_values, "catalog_coverage"),
        coverage(tail, long_tail, k_values, "long_tail_coverage"),
        category_diversity(shown, items, k_values),
    )
    for part in parts:
        means = means.join(F.broadcast(part))
    return means


def _unset(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return c.isNull() | text.isin("", "none", "null", "nan", "unknown")


def exact_or_null_match(predicted: Column, expected: Column) -> Column:
    """1 when both are unset or equal after trimming and lower-casing."""
    same = F.lower(F.trim(predicted.cast("string"))) == F.lower(F.trim(expected.cast("string")))
    return (
        F.when(_unset(expected), _unset(predicted).cast("double"))
        .when(_unset(predicted), 0.0)
        .otherwise(same.cast("double"))
    )


QUERY_FIELDS = ("intent", "category", "brand", "price_constraint", "use_case")


def query_understanding_per_query(outputs: DataFrame) -> DataFrame:
    return outputs.select(
        "query_id",
        "split",
        "provider",
        F.col("parse_success").cast("double").alias("parse_success"),
        F.col("schema_valid").cast("double").alias("schema_valid"),
        *[
            exact_or_null_match(F.col(f"parsed_{f}"), F.col(f"source_{f}")).alias(f"{f}_match")
            for f in QUERY_FIELDS
        ],
        F.size("expanded_queries").alias("num_expanded_queries"),
        "estimated_cost_usd",
    )


def query_understanding_metrics(outputs: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    per_query = query_understanding_per_query(outputs)
    return per_query.groupBy(*by).agg(
        F.count("*").alias("num_queries"),
        F.avg("parse_success").alias("output_parse_success_rate"),
        F.avg("schema_valid").alias("schema_valid_rate"),
        *[F.avg(f"{f}_match").alias(f"{f}_match_rate") for f in QUERY_FIELDS],
        F.avg("num_expanded_queries").alias("avg_expanded_queries"),
        (F.sum("estimated_cost_usd") / F.count("*") * 1000).alias("estimated_cost_per_1000_queries"),
    )


def list_nonempty_rate(column: Column) -> Column:
    """Share of list values holding at least one non-blank text."""
    filled = F.filter(column, lambda x: F.trim(x.cast("string")) != "")
    return F.avg(F.when(F.size(filled) > 0, 1.0).otherwise(0.0))


def profile_metrics(profiles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row over all profiles: success, text length and embedding coverage."""
    embedded = embeddings.select("user_id").distinct().withColumn("_has", F.lit(1.0))
    words = F.size(F.regexp_extract_all(F.col("profile_text"), F.lit(r"\S+"), F.lit(0)))
    rows = profiles.join(embedded, "user_id", "left").withColumn("_words", words)
    return rows.agg(
        F.count("*").alias("num_users"),
        F.avg(F.col("parse_success").cast("double")).alias("profile_generation_success_rate"),
        F.avg(F.col("schema_valid").cast("double")).alias("schema_valid_rate"),
        F.avg(F.when(F.col("_words") > 0, 1.0).otherwise(0.0)).alias("profile_nonempty_rate"),
        F.avg(F.coalesce("_has", F.lit(0.0))).alias("embedding_coverage"),
        F.avg("_words").alias("avg_profile_length"),
        (F.sum("estimated_cost_usd") / F.count("*") * 1000).alias("estimated_cost_per_1000_users"),
    )


def genrec_per_query(
    outputs: DataFrame, pairs: DataFrame, catalog: DataFrame, k_values: Sequence[int] = (10,)
) -> DataFrame:
    """Validity and target metrics per generated list.

    Emitted ids meet the catalog as rows; invalid ids are those reported by the parser or absent
    from the catalog, over the number of emitted ids.
    """
    key = ["query_id", "method"]
    used = ("provider", "model", "split", "recommended_item_ids", "invalid_item_ids", "parse_success",
            "schema_valid", "used_fallback", "estimated_cost_usd")
    # answers are read once: rows made of their ids, and what is joined with them, would read them anew
    outputs = keep_columns(outputs.select(*key, *used), "outputs")
    emitted = outputs.select(*key, F.posexplode("recommended_item_ids").alias("place", "id"))
    known = catalog.select(F.col("item_id").cast("string").alias("id"), F.lit(True).alias("valid"))
    checked = skew.join_named(emitted, known, "id", "left", row_id=key)
    absent = checked.where("valid is null").groupBy(*key).agg(
        F.collect_set("id").alias("_absent"), F.count("*").alias("_absent_n")
    )
    targets = pairs.select("query_id", F.col("target_item_id").cast("string").alias("id"))
    ranks = (
        emitted.join(targets, ["query_id", "id"], "left_semi")
        .groupBy(*key)
        .agg((F.min("place") + 1).alias("_rank"))
    )
    none = F.array().cast("array<string>")
    joined = outputs.join(absent, key, "left").join(ranks, key, "left")
    size = F.size("recommended_item_ids")
    invalid = F.size(
        F.array_union(
            F.coalesce("invalid_item_ids", none), F.coalesce("_absent", none)
        )
    )
    total = F.when(size > 0, size).otherwise(invalid)
    share = F.when(size > 0, (size - F.coalesce("_absent_n", F.lit(0))) / size).otherwise(0.0)
    return joined.select(
        *key,
        "provider",
        "model",
        "split",
        share.alias("valid_item_rate"),
        F.when(total > 0, invalid / total).otherwise(0.0).alias("hallucination_rate"),
        F.col("parse_success").alias("output_parse_success"),
        "schema_valid",
        "used_fallback",
        "estimated_cost_usd",
        *_rank_columns(F.col("_rank"), k_values, ("recall", "ndcg", "mrr")),
    )


def genrec_metrics(per_query: DataFrame, faithful: DataFrame | None = None) -> DataFrame:
    """Means per method, provider, model and split; explanation rows have no item metrics."""
    key = ["method", "provider", "model", "split"]
    rows = per_query
    if faithful is not None:
        rows = per_query.unionByName(faithful, allowMissingColumns=True)
    has_faith = "explanation_faithful" in rows.columns
    flags = ("output_parse_success", "schema_valid", "used_fallback")
    summary = rows.groupBy(*key).agg(
        F.count("*").alias("num_queries"),
        F.avg("valid_item_rate").alias("valid_item_rate"),
        F.avg("hallucination_rate").alias("hallucination_rate"),
        *[F.avg(F.col(c).cast("double")).alias(n) for c, n in zip(
            flags, ("output_parse_success_rate", "schema_valid_rate", "fallback_rate"))],
        (F.sum("estimated_cost_usd") / F.count("*") * 1000).alias("estimated_cost_per_1000_queries"),
        *_means(rows, ("recall_at_", "ndcg_at_", "mrr_at_")),
        (
            F.avg(F.col("explanation_faithful").cast("double")) if has_faith else F.lit(None).cast("double")
        ).alias("explanation_faithfulness"),
        *_latency(rows),
    )
    return _with_p95(summary, rows, key)


def multi_relevant_metrics(
    results: DataFrame, pairs: DataFrame, k_values: Sequence[int] = (10, 50)
) -> DataFrame:
    """All targets of a query text count as relevant: one row per (config_name, query_text).

    ``results`` holds (config_name, query_text, item_id, rank).
    """
    relevant = pairs.select("query_text", F.col("target_item_id").alias("item_id")).distinct()
    sizes = relevant.groupBy("query_text").agg(F.count("*").alias("num_relevant_items"))
    hits = results.join(relevant, ["query_text", "item_id"], "left_semi")
    aggregates = []
    for k in k_values:
        within = F.col("rank") <= k
        aggregates += [
            F.count_if(within).alias(f"_hits_{k}"),
            F.min(F.when(within, F.col("rank"))).alias(f"_first_{k}"),
        ]
    found = hits.groupBy("config_name", "query_text").agg(*aggregates)
    texts = results.select("config_name", "query_text").distinct().join(sizes, "query_text")
    joined = texts.join(found, ["config_name", "query_text"], "left")
    columns: list = ["config_name", "query_text", "num_relevant_items"]
    for k in k_values:
        count = F.coalesce(f"_hits_{k}", F.lit(0))
        columns += [
            F.when(count > 0, 1.0).otherwise(0.0).alias(f"hit_any_at_{k}"),
            (count / F.greatest(F.col("num_relevant_items"), F.lit(1))).alias(f"recall_multi_at_{k}"),
            F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr_any_at_{k}"),
        ]
    return joined.select(*columns)


def multi_relevant_summary(per_text: DataFrame) -> DataFrame:
    return per_text.groupBy("config_name").agg(
        F.count("*").alias("num_unique_query_texts"),
        F.avg("num_relevant_items").alias("avg_relevant_items_per_query_text"),
        F.max("num_relevant_items").alias("max_relevant_items_per_query_text"),
        *_means(per_text, ("hit_any_at_", "recall_multi_at_", "mrr_any_at_")),
    )


def query_type_breakdown(per_query: DataFrame) -> DataFrame:
    """Per config and query type: mean rank of found targets, miss rate at 10 and metric means."""
    hit = F.when(F.col("target_rank").between(1, 10), 1.0).otherwise(0.0)
    return per_query.groupBy("config_name", "query_type").agg(
        F.count("*").alias("num_queries"),
        F.avg(F.nullif(F.col("target_rank"), F.lit(0))).alias("avg_target_rank"),
        (1.0 - F.avg(hit)).alias("miss_rate_at_10"),
        *_means(per_query, ("recall_at_", "mrr_at_")),
    )
