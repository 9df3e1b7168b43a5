"""Candidate pools, ranking features, rankers and candidate selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import HashingTF, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisle import skew
from aisle.functions.scores import authority_score, cold_start_score, price_bucket
from aisle.functions.text import hashed_int, item_text, shares_token, token_overlap, tokenize
from aisle.operators import hybrid
from aisle.operators.clean import filter_split
from aisle.operators.counting import draw_unlisted
from aisle.operators.retrieval import (
    SCORE_DIGITS,
    TermIndex,
    distinct_texts,
    fill_with_zeros,
)
from aisle.operators.splits import item_index
from aisle.session import cut_lineage, keep_columns

# Columns that are never model features and the orders in which score and rank
# columns are preferred.
NON_FEATURE_COLUMNS = {
    "query_id",
    "query_text",
    "split",
    "target_item_id",
    "candidate_item_id",
    "candidate_source",
    "label",
    "price_bucket",
    "diversity_category",
    "category",
    "brand",
}
SCORE_PRIORITY = ("multimodal_score", "hybrid_score", "model_score", "bm25_score", "dense_score")
RANK_PRIORITY = ("multimodal_rank", "hybrid_rank", "model_rank", "bm25_rank", "dense_rank")
#: Training rows that a partition holds at most, on average.
FIT_ROWS = 200_000


def text_match_features() -> list[Column]:
    """Lexical features of a row with query_text and the item's text columns."""
    words = tokenize("query_text")

    def length(c: str) -> Column:
        return F.coalesce(F.size(tokenize(c)), F.lit(0)).cast("double")

    return [
        shares_token(words, "category").alias("category_match"),
        shares_token(words, "brand").alias("brand_match"),
        token_overlap(words, "title").alias("title_token_overlap"),
        token_overlap(words, "description").alias("description_token_overlap"),
        length("query_text").alias("query_length"),
        length("title").alias("item_title_length"),
        length("description").alias("item_description_length"),
    ]


def item_popularity(train: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("event_weight"), F.lit(0.0))
    return train.groupBy("item_id").agg(
        F.count("*").alias("item_popularity_count"),
        F.sum(weight).alias("item_event_weight_sum"),
        F.count_if(F.col("event_type") == "purchase").alias("item_purchase_count"),
        F.count_if(F.col("event_type") == "add_to_cart").alias("item_add_to_cart_count"),
    )


def conversion_proxy(popularity: DataFrame) -> DataFrame:
    bought = F.col("item_purchase_count") + 0.5 * F.col("item_add_to_cart_count")
    rate = bought / F.greatest(F.col("item_popularity_count"), F.lit(1))
    return popularity.withColumn("conversion_proxy", rate)


def business_proxies(train: DataFrame, items: DataFrame) -> DataFrame:
    """Popularity and conversion per catalog item, 0 where it has no events."""
    proxies = conversion_proxy(item_popularity(train))
    return items.select("item_id").join(proxies, "item_id", "left").na.fill(0)


def candidate_pool(
    pairs: DataFrame,
    catalog: DataFrame,
    hybrid: DataFrame,
    bm25: DataFrame,
    dense: DataFrame,
    pool: int = 50,
    random_negatives: int = 10,
    ensure_positive: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Candidates per query from ranked lists (query_id, item_id, rank) of any length.

    Lists are taken in the order hybrid, bm25, dense up to ``pool`` items, a missing target is
    added, and pools still short receive hashed draws from the rest of the catalog.
    """
    sources = (("hybrid", hybrid), ("bm25", bm25), ("dense", dense))
    stacked = None
    for place, (name, ranked) in enumerate(sources):
        part = ranked.select(
            "query_id", "item_id", F.lit(place).alias("p"), F.col("rank").alias("r"), F.lit(name).alias("s")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    merged = stacked.groupBy("query_id", "item_id").agg(
        F.min(F.struct("p", "r")).alias("first"),
        *[F.max(F.col("s") == n).alias(n) for n in ("bm25", "dense", "hybrid")],
    )
    order = Window.partitionBy("query_id").orderBy("first", "item_id")
    listed = (
        merged.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= pool)
        .select("query_id", "item_id", "bm25", "dense", "hybrid")
        .withColumns({"forced": F.lit(False), "random": F.lit(False)})
    )
    listed = keep_columns(listed, "pool")
    # so many rows may fill few bytes of a file, and would be taken for a table to send to all tasks
    apart = listed.hint("merge")
    no = F.lit(False)
    if ensure_positive:
        targets = pairs.select("query_id", F.col("target_item_id").alias("item_id")).distinct()
        missing = targets.join(apart, ["query_id", "item_id"], "left_anti")
        seen_in = missing.join(
            merged.select("query_id", "item_id", "bm25", "dense", "hybrid").hint("merge"),
            ["query_id", "item_id"],
            "left",
        ).na.fill(False)
        listed = listed.unionByName(
            seen_in.withColumns({"forced": F.lit(True), "random": no})
        )
    index = cut_lineage(item_index(catalog))
    size = index.agg(F.count("*")).scalar()
    held = listed.groupBy("query_id").agg(F.count("*").alias("_held"))
    draws = (
        pairs.select("query_id")
        .distinct()
        .join(held.hint("merge"), "query_id", "left")
        .withColumn("_held", F.coalesce("_held", F.lit(0)))
        .withColumn("_free", size - F.col("_held"))
        .withColumn(
            "_k",
            F.least(F.lit(random_negatives).cast("long"), F.lit(pool) - F.col("_held"), F.col("_free")),
        )
        .where("_k > 0")
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        .drop("_held")
    )
    numbers = F.broadcast(index) if skew.fits_broadcast(index) else index
    places = skew.join(listed.select("query_id", "item_id").hint("merge"), numbers, "item_id").select(
        "query_id", "item_idx"
    )
    hashed = hashed_int(F.lit(seed), "query_id", "draw")
    drawn = skew.join(draw_unlisted(draws, places, ["query_id"], hashed, size), index, "item_idx")
    extra = drawn.select("query_id", "item_id").withColumns(
        {"bm25": no, "dense": no, "hybrid": no, "forced": no, "random": F.lit(True)}
    )
    tags = [
        F.when(F.col(flag), label)
        for flag, label in (
            ("bm25", "bm25"),
            ("dense", "dense"),
            ("hybrid", "hybrid"),
            ("forced", "positive_forced"),
            ("random", "random_negative"),
        )
    ]
    return listed.unionByName(extra).select(
        "query_id",
        F.col("item_id").alias("candidate_item_id"),
        F.concat_ws("+", *tags).alias("candidate_source"),
    )


def ranking_features(
    pairs: DataFrame,
    items: DataFrame,
    train: DataFrame,
    bm25: TermIndex,
    tfidf: TermIndex,
    pool: int = 50,
    ensure_positive: bool = True,
    bm25_weight: float = 0.5,
    dense_weight: float = 0.5,
) -> DataFrame:
    """One row per (query, candidate) with scores, full-catalog ranks and item features.

    Everything that depends on the text and the item alone is computed once per distinct text and
    handed to the queries at the end. Ranks cover the catalog, so the hybrid list fills the pool.
    """
    texts = cut_lineage(distinct_texts(pairs))
    index = hybrid.fused_index(bm25, tfidf)
    search = hybrid.fused_search(index, texts, pool, bm25_weight, dense_weight)
    top = cut_lineage(search.top.withColumnRenamed("score", "hybrid_score"))
    pooled = fill_with_zeros(top, texts, bm25.item_ids, pool, ["hybrid_score"]).select(
        "query_text", "item_id", F.lit(True).alias("pooled")
    )
    wanted = pooled
    if ensure_positive:
        targets = pairs.select(
            "query_text", F.col("target_item_id").alias("item_id"), F.lit(False).alias("pooled")
        )
        wanted = pooled.unionByName(targets).groupBy("query_text", "item_id").agg(
            F.max("pooled").alias("pooled")
        )
    wanted = cut_lineage(wanted)
    places = cut_lineage(item_index(items))
    ranked = hybrid.catalog_ranks(index, search, wanted.drop("pooled"), places)
    details = business_proxies(train, items).join(items, "item_id")
    rating = F.coalesce("avg_rating", F.lit(0.0))
    count = F.coalesce("rating_count", F.lit(0))
    price = F.coalesce("price", F.lit(0.0))
    features = (
        skew.join(ranked.join(wanted, ["query_text", "item_id"]), details, "item_id")
        .select(
            "query_text",
            "pooled",
            F.col("item_id").alias("candidate_item_id"),
            *[f"{n}_{what}" for what in ("score", "rank") for n in ("bm25", "dense", "hybrid")],
            *text_match_features(),
            F.col("item_popularity_count").cast("double").alias("item_popularity_count"),
            "item_event_weight_sum",
            F.col("item_purchase_count").cast("double").alias("item_purchase_count"),
            F.col("item_add_to_cart_count").cast("double").alias("item_add_to_cart_count"),
            rating.alias("avg_rating"),
            count.alias("rating_count"),
            F.log1p(F.greatest(count, F.lit(0)).cast("double")).alias("log_rating_count"),
            price.alias("price"),
            price_bucket(price).alias("price_bucket"),
            authority_score(rating, count).alias("authority_score"),
            "conversion_proxy",
            cold_start_score("item_popularity_count").alias("cold_start_score"),
            F.coalesce("category", F.lit("")).alias("diversity_category"),
            "category",
            "brand",
        )
    )
    # rows of texts and items are kept, the far more rows of queries and candidates never are
    features = keep_columns(features, "features")
    queries = pairs.select("query_id", "query_text", "split", "target_item_id")
    pooled_rows = features.where("pooled")
    parts = None
    if skew.fits_broadcast(pooled_rows):
        # queries are laid out by id before their rows are made, so that steps per query move no candidate row
        parts = skew.layout_parts(pairs, pairs.count() * (pool + 1))
        shared = queries.repartition(parts, "query_id").join(F.broadcast(pooled_rows), "query_text")
    else:
        shared = skew.join(
            queries,
            pooled_rows,
            "query_text",
            keys_from=pairs,
            row_id=["query_id"],
            rows=max(1, skew.hot_rows(pairs) // pool),
        )
    if ensure_positive:
        # a row per query at most, which a small file may hold, so they are not sent to all tasks
        own = features.where("not pooled").withColumnRenamed("candidate_item_id", "target_item_id").hint("merge")
        forced = queries.join(own, ["query_text", "target_item_id"]).withColumn(
            "candidate_item_id", F.col("target_item_id")
        )
        if parts is not None:
            forced = forced.repartition(parts, "query_id")
        shared = shared.unionByName(forced)
    source = F.when(F.col("pooled"), "bm25+dense+hybrid").otherwise(
        "bm25+dense+hybrid+positive_forced"
    )
    label = (F.col("candidate_item_id") == F.col("target_item_id")).cast("int")
    out = shared.withColumn("candidate_source", source).withColumn("label", label).drop("pooled")
    lead = ["query_id", "query_text", "split", "target_item_id", "candidate_item_id", "label",
            "candidate_source"]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Per split: queries, share with a positive and mean candidates per query."""
    per_query = candidates.groupBy("split", "query_id").agg(
        F.max("label").alias("positive"), F.count("*").alias("n")
    )
    return per_query.groupBy("split").agg(
        F.count("*").alias("num_queries"),
        F.avg("positive").alias("positive_coverage"),
        F.avg("n").alias("avg_candidates_per_query"),
    )


def numeric_feature_columns(df: DataFrame) -> list[str]:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return sorted(numeric - NON_FEATURE_COLUMNS)


def standardize(train: DataFrame, other: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """z-scores of ``other`` with the mean and sample deviation of ``train``; null counts as 0."""
    names = list(columns or numeric_feature_columns(train))
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in names],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in names],
        ).alias("stats")
    ).scalar()
    row = other.withColumn("_stats", stats)

    def scaled(name: str) -> Column:
        deviation = F.col(f"_stats.s_{name}")
        safe = F.when(deviation.isNull() | (deviation == 0), F.lit(1.0)).otherwise(deviation)
        return (F.coalesce(F.col(name), F.lit(0)) - F.col(f"_stats.m_{name}")) / safe

    return row.withColumns({c: scaled(c) for c in names}).drop("_stats")


# Component weights of the mixed ranking.
MIX_WEIGHTS = {
    "relevance": 0.65,
    "authority": 0.15,
    "conversion": 0.10,
    "diversity": 0.05,
    "cold_start": 0.05,
}


def mixed_rank(
    candidates: DataFrame,
    k: int | None = None,
    base: str = "hybrid_score",
    group: str = "category",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Blend of per-query scaled scores and a diversity share, ranked per query.

    Candidate lists are bounded by the pool, so windows per query stay small.
    """
    w = {**MIX_WEIGHTS, **(weights or {})}
    per_query = Window.partitionBy("query_id")

    def scaled(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        low, high = F.min(value).over(per_query), F.max(value).over(per_query)
        return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))

    order = Window.partitionBy("query_id", group).orderBy(F.col(base).desc(), "candidate_item_id")
    parts = {
        "relevance_component": scaled(base),
        "authority_component": scaled("authority_score"),
        "conversion_component": scaled("conversion_proxy"),
        "cold_start_component": scaled("cold_start_score"),
        "diversity_component": 1.0 / F.row_number().over(order),
    }
    scored = candidates.withColumns(parts)
    total = sum(
        (F.lit(w[n]) * F.col(f"{n}_component") for n in MIX_WEIGHTS), F.lit(0.0)
    )
    scored = scored.withColumn("model_score", F.round(total, SCORE_DIGITS))
    best = per_query.orderBy(F.col("model_score").desc(), "candidate_item_id")
    ranked = scored.withColumn("model_rank", F.row_number().over(best))
    return ranked if k is None else ranked.where(F.col("model_rank") <= k)


#: Rows of a weighted fit that stops before it converges, besides one for each distinct row.
SPLIT_ROWS = 2_000_000
#: Number of equal training rows, as the weight of the one that stands for them.
WEIGHT = "_weight"


def _classifier(method: str, width: int, seed: int, regularization: float, settings: dict):
    if method == "linear":
        options = {"regParam": 0.001 * regularization, "maxIter": 100, "standardization": True, **settings}
        return LogisticRegression(weightCol=WEIGHT, **options)
    if method in ("gbt", "lightgbm"):
        options = {"maxIter": 30, "stepSize": 0.05, "seed": seed, **settings}
        return GBTClassifier(weightCol=WEIGHT, **options)
    if method == "mlp":
        hidden = settings.pop("hidden", [64, 32])
        return MultilayerPerceptronClassifier(layers=[width, *hidden, 2], seed=seed, **settings)
    raise ValueError(f"unsupported ranking method: {method}")


def _fit_layout(rows: DataFrame, spread: bool = False) -> DataFrame:
    """All ``rows`` in no more partitions than cores or sizes ask for: a fit has hundreds of short jobs over them.

    With ``spread`` they are laid out anew, in just so many.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, 2 * cores, -(-rows.count() // FIT_ROWS))
    return rows.repartition(parts) if spread else rows.coalesce(parts)


def _weighed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are equal in ``keys`` once, with their number: a weighted fit has the sums of all rows."""
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias(WEIGHT))


def _split(rows: DataFrame, total: float) -> DataFrame:
    """Rows of large weight as several of a smaller one, of 1 where all rows are no more than ``SPLIT_ROWS``.

    Spark's deviation of weighted rows then differs less from that of all rows, and so do the steps of a fit.
    """
    copies = F.ceil(F.col(WEIGHT) / F.lit(max(1.0, total / SPLIT_ROWS)))
    listed = rows.withColumn("_copies", F.array_repeat(F.col(WEIGHT) / copies, copies.cast("int")))
    return listed.withColumn(WEIGHT, F.explode("_copies")).drop("_copies")


def _weight_share(total: float, squares: float) -> float:
    """Sample variance of all rows by that which Spark gives for the weighted ones."""
    return (total - squares / total) / (total - 1) if total > 1 and total * total > squares else 1.0


def _fit_scaler(scaler: StandardScaler, assembled: DataFrame) -> tuple[StandardScalerModel, float]:
    """The scaler fitted as on all rows, and ``_weight_share`` of the weighted ones."""
    vector, weight = F.col(scaler.getInputCol()), F.col(WEIGHT)
    stats, total, squares = assembled.agg(
        Summarizer.metrics("mean", "std").summary(vector, weight), F.sum(weight), F.sum(weight * weight)
    ).first()
    if not total:
        return scaler.fit(assembled), 1.0
    share = _weight_share(total, squares)
    # two rows whose mean and sample deviation are those of all rows
    mean, apart = stats["mean"].toArray(), stats["std"].toArray() * math.sqrt(share / 2)
    two = [(Vectors.dense(mean - apart),), (Vectors.dense(mean + apart),)]
    return scaler.fit(assembled.sparkSession.createDataFrame(two, [scaler.getInputCol()])), share


def train_ranker(
    candidates: DataFrame,
    method: str = "linear",
    columns: Sequence[str] | None = None,
    seed: int = 42,
    **settings,
) -> PipelineModel:
    """Fit a feature ranker on the train split; the fitted pipeline can be written and read.

    Linear and tree models sum over rows, so equal rows are one row with their number as weight.
    """
    names = list(columns or numeric_feature_columns(candidates))
    rows = filter_split(candidates, "train").na.fill(0.0, names)
    assembler = VectorAssembler(inputCols=names, outputCol="raw_features", handleInvalid="keep")
    scaler, share = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), 1.0
    if method == "mlp":
        rows = _fit_layout(rows)
    else:
        rows = _fit_layout(keep_columns(_weighed(rows, [*names, "label"]), "examples"), spread=True)
        scaler, share = _fit_scaler(scaler, assembler.transform(rows))
    # the penalty is on coefficients in units of the deviation, which Spark takes from the weighted rows
    stages = [assembler, scaler, _classifier(method, len(names), seed, share, dict(settings))]
    return Pipeline(stages=stages).fit(rows)


def linear_ranker(candidates: DataFrame, **settings) -> PipelineModel:
    return train_ranker(candidates, "linear", **settings)


def gbt_ranker(candidates: DataFrame, **settings) -> PipelineModel:
    return train_ranker(candidates, "gbt", **settings)


def mlp_ranker(candidates: DataFrame, **settings) -> PipelineModel:
    return train_ranker(candidates, "mlp", **settings)


def score_candidates(model: PipelineModel, candidates: DataFrame, name: str = "model_score") -> DataFrame:
    """Candidates with the model's probability of the positive class."""
    scored = model.transform(candidates).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*[c for c in candidates.columns if c != name], name)


def pair_vocabulary(
    candidates: DataFrame, items: DataFrame, max_vocab_size: int = 5000
) -> DataFrame:
    """(term, term_id) of the most frequent query and item tokens; ids start at 4.

    Rows are counted per text and per item first, so each text is split once.
    """
    per_text = candidates.groupBy("query_text").agg(F.count("*").alias("n"))
    per_item = candidates.groupBy(F.col("candidate_item_id").alias("item_id")).agg(
        F.count("*").alias("n")
    )
    words = per_text.select("n", F.explode(tokenize("query_text")).alias("term")).unionByName(
        per_item.join(items, "item_id").select("n", F.explode(tokenize(item_text())).alias("term"))
    )
    limit = max(0, max_vocab_size - 4)
    best = (
        words.groupBy("term")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "term")
        .limit(limit)
    )
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "term")))
    numbered = best.agg(listed.alias("v")).select(F.posexplode("v").alias("p", "v"))
    return numbered.select(F.col("v.term").alias("term"), (F.col("p") + 4).cast("int").alias("term_id"))


def _token_ids(texts: DataFrame, key: str, text: Column, vocabulary: DataFrame, limit: int) -> DataFrame:
    """Vocabulary ids of the tokens that can still fit into a pair of ``limit`` entries."""
    words = texts.select(key, F.posexplode(F.slice(tokenize(text), 1, limit)).alias("p", "term"))
    ids = words.join(F.broadcast(vocabulary), "term", "left").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("p", F.coalesce("term_id", F.lit(3)).alias("i")))).alias("e")
    )
    return ids.select(key, F.col("e.i").alias("ids"))


def pair_encode(
    candidates: DataFrame, items: DataFrame, vocabulary: DataFrame, max_pair_len: int = 64
) -> DataFrame:
    """[CLS] query [SEP] item as ``max_pair_len`` ids: PAD 0, CLS 1, SEP 2, unknown 3.

    Each distinct text and each item is encoded once.
    """
    texts = _token_ids(
        candidates.select("query_text").distinct(), "query_text", F.col("query_text"), vocabulary, max_pair_len
    ).withColumnRenamed("ids", "query_ids")
    things = _token_ids(items, "item_id", item_text(), vocabulary, max_pair_len).select(
        F.col("item_id").alias("candidate_item_id"), F.col("ids").alias("item_ids")
    )
    keys = candidates.select("query_id", "query_text", "candidate_item_id")
    joined = skew.join(
        keys, texts, "query_text", "left", keys_from=keys, row_id=["query_id", "candidate_item_id"]
    )
    joined = skew.join(
        joined, things, "candidate_item_id", "left", keys_from=keys, row_id=["query_id"]
    )
    none = F.array().cast("array<int>")
    ids = F.slice(
        F.concat(
            F.array(F.lit(1)),
            F.coalesce("query_ids", none),
            F.array(F.lit(2)),
            F.coalesce("item_ids", none),
        ),
        1,
        max_pair_len,
    )
    padded = F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_pair_len) - F.size(ids)))
    return joined.select("query_id", "candidate_item_id", padded.alias("input_ids"))


def _pair_tokens(candidates: DataFrame, items: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Crossed token pairs next to plain query and item tokens, one array per candidate row."""
    bodies = items.select(
        F.col("item_id").alias("candidate_item_id"),
        F.array_distinct(tokenize(item_text())).alias("_item"),
    )
    joined = skew.join(
        candidates, bodies, "candidate_item_id", keys_from=candidates, row_id=row_id
    ).withColumn(
        "_query", F.array_distinct(tokenize("query_text"))
    )
    crossed = F.flatten(
        F.transform(
            "_query",
            lambda a: F.transform("_item", lambda b: F.concat(a, F.lit("~"), b)),
        )
    )
    shared = F.transform(F.array_intersect("_query", "_item"), lambda a: F.concat(F.lit("="), a))
    return joined.withColumn("pair_tokens", F.concat(crossed, shared)).drop("_query", "_item")


def pair_text_ranker(
    candidates: DataFrame, items: DataFrame, features: int = 1 << 16
) -> PipelineModel:
    """Linear model over hashed query-token and item-token pairs, fitted on the train split.

    Equal rows are one row with their number as weight, see ``train_ranker``.
    """
    keys = ["query_text", "candidate_item_id", "label"]
    examples = keep_columns(_weighed(filter_split(candidates, "train"), keys), "examples")
    total = examples.agg(F.sum(WEIGHT)).first()[0]
    rows = _split(_pair_tokens(examples, items, ["query_text"]), total or 0.0)
    total, squares = rows.agg(F.sum(WEIGHT), F.sum(F.col(WEIGHT) * F.col(WEIGHT))).first()
    share = _weight_share(total, squares) if total else 1.0
    # the penalty is on coefficients in units of the deviation, which Spark takes from the weighted rows
    hashing = HashingTF(inputCol="pair_tokens", outputCol="features", numFeatures=features, binary=True)
    linear = LogisticRegression(regParam=0.001 * share, maxIter=30, weightCol=WEIGHT)
    return Pipeline(stages=[hashing, linear]).fit(_fit_layout(rows, spread=True))


def score_pair_text(
    model: PipelineModel, candidates: DataFrame, items: DataFrame
) -> DataFrame:
    """Candidates with the model's probability; pairs of text and item that come more than once are scored once,
    unless they are many."""
    pair = ["query_text", "candidate_item_id"]
    columns = [c for c in candidates.columns if c != "model_score"]

    def scored(rows: DataFrame, row_id: list[str]) -> DataFrame:
        found = model.transform(_pair_tokens(rows, items, row_id))
        return found.withColumn("model_score", vector_to_array("probability")[1])

    counted = candidates.dropna(subset=pair).groupBy(*pair).agg(F.count("*").alias("_n"))
    repeated = cut_lineage(counted.where("_n > 1").select(*pair).limit(skew.BROADCAST_ROWS + 1))
    if repeated.isEmpty() or repeated.count() > skew.BROADCAST_ROWS:
        return scored(candidates, ["query_id"]).select(*columns, "model_score")
    known = cut_lineage(scored(repeated, ["query_text"]).select(*pair, "model_score"))
    others = candidates.join(F.broadcast(repeated), pair, "left_anti")
    return (
        candidates.drop("model_score")
        .join(F.broadcast(known), pair)
        .select(*columns, "model_score")
        .unionByName(scored(others, ["query_id"]).select(*columns, "model_score"))
    )


def augment_scores(
    candidates: DataFrame,
    scored: DataFrame,
    catalog_size: Column,
    score: str = "multimodal_score",
    rank: str = "multimodal_rank",
) -> DataFrame:
    """Score and rank of another retriever per candidate row; absent ones get 0 and N + 1."""
    found = scored.select(
        "query_id",
        F.col("item_id").alias("candidate_item_id"),
        F.col("score").alias(score),
        F.col("rank").cast("long").alias(rank),
    )
    joined = candidates.join(found, ["query_id", "candidate_item_id"], "left")
    return joined.withColumns(
        {
            score: F.coalesce(score, F.lit(0.0)),
            rank: F.coalesce(F.col(rank), (catalog_size + 1).cast("long")),
        }
    )


def top_candidates(
    candidates: DataFrame, n: int, score_priority: Sequence[str] = SCORE_PRIORITY
) -> DataFrame:
    """Best ``n`` distinct candidates per query by the first score and rank column present."""
    have = set(candidates.columns)
    score = next((c for c in score_priority if c in have), None)
    rank = next((c for c in RANK_PRIORITY if c in have), None)
    score_value = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    rank_value = F.lit(1) if rank is None else F.coalesce(F.col(rank), F.lit(1_000_000))
    best = F.struct((-score_value).alias("s"), rank_value.alias("r"))
    # both windows run on the one layout by query, whose lists are bounded by the pool
    per_query = Window.partitionBy("query_id")
    item = F.struct("candidate_item_id")
    before = F.lag(item).over(per_query.orderBy("candidate_item_id", "_best"))
    return (
        candidates.withColumn("_best", best)
        .withColumn("_copy", before.eqNullSafe(item))
        .where(~F.col("_copy"))
        .withColumn("candidate_rank", F.row_number().over(per_query.orderBy("_best", "candidate_item_id")))
        .where(F.col("candidate_rank") <= n)
        .drop("_best", "_copy")
    )
