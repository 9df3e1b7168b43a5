"""Recommenders over user-item weights: popularity, item similarity, factors, content, profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators.counting import nth_unlisted
from aisle.operators.retrieval import SCORE_DIGITS, TermIndex
from aisle.operators.splits import item_index
from aisle.operators.vectors import block_topk
from aisle.session import cut_lineage

PAIR_HOT_ROWS = 20_000


def user_history(interactions: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id) pairs: the seen lookup."""
    return interactions.select("user_id", "item_id").distinct()


def user_item_weights(interactions: DataFrame) -> DataFrame:
    if "event_weight" in interactions.columns:
        weight = F.coalesce(F.col("event_weight").cast("double"), F.lit(1.0))
    else:
        weight = F.lit(1.0)
    return interactions.groupBy("user_id", "item_id").agg(F.sum(weight).alias("weight"))


def popularity_scores(train: DataFrame, score_column: str = "event_weight") -> DataFrame:
    if score_column in train.columns:
        value = F.sum(F.coalesce(F.col(score_column).cast("double"), F.lit(1.0)))
    else:
        value = F.count("*").cast("double")
    return train.groupBy("item_id").agg(value.alias("score"))


def _slots(users: DataFrame, listed: DataFrame, size: Column, k: int) -> DataFrame:
    """One row per user and free list place: draw = _at = 0.. up to k or the unlisted count."""
    held = listed.groupBy("user_id").agg(F.count("*").alias("_held"))
    free = F.least(F.lit(k).cast("long"), size - F.coalesce("_held", F.lit(0)))
    return (
        users.join(held, "user_id", "left")
        .withColumn("_free", free)
        .where("_free > 0")
        .withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_free") - 1)))
        .drop("_held", "_free")
    )


def popularity_recs(
    train: DataFrame,
    catalog: DataFrame,
    users: DataFrame,
    k: int = 10,
    exclude_seen: bool = True,
    score_column: str = "event_weight",
) -> DataFrame:
    """Most popular catalog items per user without the seen ones.

    The catalog is ranked once; each user's r-th unseen place in it is computed from the places
    of the seen items, so no user-by-item table is built and no history length is assumed.
    """
    scored = (
        catalog.select("item_id")
        .join(popularity_scores(train, score_column), "item_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )
    ranked = skew.row_number(
        scored, [], [(-F.col("score")).alias("s"), F.col("item_id")], "item_idx", ["item_id"]
    )
    ranked = cut_lineage(ranked.select("item_id", "item_idx", "score"))
    size = ranked.agg(F.count("*")).scalar()
    seen = skew.join(
        user_history(train), users.select("user_id"), "user_id", "left_semi", keys_from=train
    )
    listed = skew.join(seen, ranked, "item_id", keys_from=train).select("user_id", "item_idx")
    if not exclude_seen:
        listed = listed.where(F.lit(False))
    slots = _slots(users.select("user_id"), listed, size, k).withColumn("_r", F.col("_at"))
    chosen = nth_unlisted(slots, listed, ["user_id"], size, below=k, keys_from=train)
    return skew.join(chosen, ranked, "item_idx").select(
        "user_id", "item_id", "score", (F.col("_r") + 1).cast("int").alias("rank")
    )


def rank_unseen(
    scores: DataFrame,
    users: DataFrame,
    seen: DataFrame | None,
    catalog: DataFrame,
    k: int = 10,
    fill: bool = True,
) -> DataFrame:
    """Top ``k`` unseen catalog items per user; items without a score count as 0 in id order.

    Scores of items outside the catalog are left out. Negative scores come behind the items
    without a score; without ``fill`` only positive scores are listed.
    """
    wanted = skew.join(scores, users.select("user_id"), "user_id", "left_semi")
    wanted = wanted.join(catalog.select("item_id"), "item_id", "left_semi")
    if seen is not None:
        wanted = wanted.join(seen, ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
    if fill:
        wanted = cut_lineage(wanted.where("score <> 0").select("user_id", "item_id", "score"))
    top = (
        wanted.where("score > 0")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("user_id", "item_id", "score", "rank")
    )
    if not fill:
        return top
    top = cut_lineage(top)
    counts = top.groupBy("user_id").agg(F.count("*").alias("_m"))
    short = (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .withColumn("_m", F.coalesce("_m", F.lit(0)))
        .where(F.col("_m") < k)
    )
    below = wanted.where("score < 0").join(short, "user_id")
    index = item_index(catalog)
    size = index.agg(F.count("*")).scalar()
    taken = top.select("user_id", "item_id").unionByName(below.select("user_id", "item_id"))
    if seen is not None:
        taken = taken.unionByName(seen.select("user_id", "item_id"))
    taken = skew.join(taken.distinct(), short.select("user_id"), "user_id", "left_semi")
    taken = cut_lineage(taken)
    listed = skew.join(taken, index, "item_id", keys_from=taken).select("user_id", "item_idx")
    slots = _slots(short, listed, size, k).where(F.col("_at") < k - F.col("_m"))
    slots = slots.withColumn("rank", (F.col("_m") + F.col("_at") + 1).cast("int"))
    filler = nth_unlisted(slots, listed, ["user_id"], size, below=k, keys_from=taken)
    named = skew.join(filler, index, "item_idx").select(
        "user_id", "item_id", F.lit(0.0).alias("score"), "rank"
    )
    held = listed.groupBy("user_id").agg(F.count("*").alias("_held"))
    behind = F.col("_m") + size - F.col("_held") + F.row_number().over(order)
    last = below.join(held, "user_id").withColumn("rank", behind.cast("int"))
    last = last.where(F.col("rank") <= k).select("user_id", "item_id", "score", "rank")
    return top.unionByName(named).unionByName(last)


def with_unscored(
    top: DataFrame, scored: DataFrame, users: DataFrame, seen: DataFrame | None, catalog: DataFrame, k: int
) -> DataFrame:
    """Completes the ``k`` best ``scored`` items per user by catalog items outside ``scored``.

    Those count as 0 in id order, so they stand before negative scores.
    """
    top = cut_lineage(top.select("user_id", "item_id", "score"))
    above = top.where("score > 0").groupBy("user_id").agg(F.count("*").alias("_m"))
    short = users.select("user_id").join(above, "user_id", "left")
    short = short.where(F.coalesce("_m", F.lit(0)) < k).select("user_id")
    others = catalog.select("item_id").join(scored.select("item_id"), "item_id", "left_anti")
    zeros = rank_unseen(top.limit(0), short, seen, others, k).select("user_id", "item_id", "score")
    order = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
    both = top.unionByName(zeros).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= k)


def itemcf_similarity(
    train: DataFrame, min_cooccurrence: int = 1, max_neighbors: int = 50
) -> DataFrame:
    """Cosine between item columns of the user-item weights: (item_i, item_j, similarity).

    Each unordered pair is formed once per common user and added up before the shuffle; users
    with long histories are spread over several tasks. Of every column j the best neighbours stay.
    """
    weights = user_item_weights(train)
    norms = weights.groupBy("item_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    unit = skew.join(weights, norms, "item_id", keys_from=train).select(
        "user_id", "item_id", (F.col("weight") / F.col("norm")).alias("w")
    )
    left = unit.withColumnsRenamed({"item_id": "a", "w": "wa"})
    right = unit.withColumnsRenamed({"item_id": "b", "w": "wb"})
    pairs = (
        skew.join(left, right, "user_id", keys_from=train, row_id=["a"], rows=PAIR_HOT_ROWS)
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("s"), F.count("*").alias("n"))
        .where(F.col("n") >= min_cooccurrence)
    )
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("i"), F.col("b").alias("j")),
            F.struct(F.col("b").alias("i"), F.col("a").alias("j")),
        )
    )
    similarity = pairs.select(both.alias("p"), F.round("s", SCORE_DIGITS).alias("similarity")).select(
        F.col("p.i").alias("item_i"), F.col("p.j").alias("item_j"), "similarity"
    )
    if max_neighbors <= 0:
        return similarity
    order = Window.partitionBy("item_j").orderBy(F.col("similarity").desc(), "item_i")
    return (
        similarity.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max_neighbors)
        .drop("_n")
    )


def with_popularity(
    scored: DataFrame,
    train: DataFrame,
    catalog: DataFrame,
    users: DataFrame,
    k: int,
    exclude_seen: bool,
    fill: bool = True,
) -> DataFrame:
    """Rank the scored users; users without any score get popularity lists."""
    scored = cut_lineage(scored)
    known = scored.select("user_id").distinct()
    seen = user_history(train) if exclude_seen else None
    reached = users.select("user_id").join(known, "user_id", "left_semi")
    others = users.select("user_id").join(known, "user_id", "left_anti")
    own = rank_unseen(scored, reached, seen, catalog, k, fill)
    return own.unionByName(popularity_recs(train, catalog, others, k, exclude_seen))


def itemcf_recs(
    train: DataFrame,
    catalog: DataFrame,
    users: DataFrame,
    k: int = 10,
    min_cooccurrence: int = 1,
    max_neighbors: int = 50,
    exclude_seen: bool = True,
) -> DataFrame:
    """Sum of similarity times weight over each user's items, popularity where that is empty."""
    similarity = itemcf_similarity(train, min_cooccurrence, max_neighbors)
    wanted = skew.join(
        user_item_weights(train), users.select("user_id"), "user_id", "left_semi", keys_from=train
    )
    scored = (
        skew.join(
            wanted.withColumnRenamed("item_id", "item_j"),
            similarity,
            "item_j",
            keys_from=train.select(F.col("item_id").alias("item_j")),
            row_id=["user_id"],
        )
        .groupBy("user_id", F.col("item_i").alias("item_id"))
        .agg(F.round(F.sum(F.col("similarity") * F.col("weight")), SCORE_DIGITS).alias("score"))
        .where("score > 0")
    )
    return with_popularity(scored, train, catalog, users, k, exclude_seen)


class Factors(NamedTuple):
    """Learned vectors: users (user_id, vec) and items (item_id, vec)."""

    users: DataFrame
    items: DataFrame


def mf_model(
    train: DataFrame, factors: int = 16, iterations: int = 20, reg: float = 0.01, seed: int = 42
) -> Factors:
    """Implicit matrix factorisation of summed weights; ids of any type are numbered first."""
    weights = cut_lineage(user_item_weights(train))
    places = {}
    for key in ("user_id", "item_id"):
        ids = weights.select(key).distinct()
        places[key] = cut_lineage(skew.row_number(ids, [], [F.col(key)], f"{key}_at", [key]))
        places[key] = places[key].withColumn(f"{key}_at", F.col(f"{key}_at").cast("int"))
    rated = skew.join(weights, places["user_id"], "user_id", keys_from=weights, row_id=["item_id"])
    rated = skew.join(rated, places["item_id"], "item_id", keys_from=weights, row_id=["user_id"])
    als = ALS(
        rank=factors, maxIter=iterations, regParam=reg, implicitPrefs=True, seed=seed,
        userCol="user_id_at", itemCol="item_id_at", ratingCol="weight",
    )
    model = als.fit(rated.select("user_id_at", "item_id_at", "weight"))
    return Factors(
        *[
            places[key]
            .join(learned.select(F.col("id").alias(f"{key}_at"), F.col("features").alias("vec")), f"{key}_at")
            .select(key, "vec")
            for key, learned in (("user_id", model.userFactors), ("item_id", model.itemFactors))
        ]
    )


def mf_recs(
    model: Factors, train: DataFrame, catalog: DataFrame, users: DataFrame, k: int = 10,
    exclude_seen: bool = True,
) -> DataFrame:
    """Factor products of known users over the catalog; others get popularity lists.

    Items without a vector count as 0.
    """
    known = users.select("user_id").join(model.users.select("user_id"), "user_id", "left_semi")
    reached = model.users.join(known, "user_id", "left_semi").withColumnRenamed("user_id", "query_id")
    items = model.items.join(catalog.select("item_id"), "item_id", "left_semi")
    seen = user_history(train) if exclude_seen else None
    exclude = None if seen is None else seen.withColumnRenamed("user_id", "query_id")
    top = block_topk(reached, items, k, exclude=exclude).withColumnRenamed("query_id", "user_id")
    top = with_unscored(top, items, known, seen, catalog, k)
    others = users.select("user_id").join(known, "user_id", "left_anti")
    return top.unionByName(popularity_recs(train, catalog, others, k, exclude_seen))


def sparse_vectors(weights: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, idx, val) arrays of a long (key, term, weight) table over the vocabulary."""
    entries = weights.join(vocabulary, "term")
    listed = F.sort_array(F.collect_list(F.struct("place", "weight")))
    return entries.groupBy(key).agg(listed.alias("e")).select(
        key, F.col("e.place").alias("idx"), F.col("e.weight").alias("val")
    )


def vocabulary_places(index: TermIndex) -> DataFrame:
    """Every term of the index numbered from 0 in alphabetical order."""
    terms = index.terms.select("term")
    placed = skew.row_number(terms, [], [F.col("term")], "place", ["term"])
    return placed.select("term", (F.col("place") - 1).cast("int").alias("place"))


def content_profiles(train: DataFrame, index: TermIndex) -> DataFrame:
    """Unit-length weighted mean of item vectors per user: (user_id, term, weight).

    Postings meet the user weights on the item; the sums per user and term are combined before
    the shuffle.
    """
    postings = index.postings.select("item_id", "term", F.col("weight").alias("x"))
    weights = user_item_weights(train)
    summed = (
        skew.join(weights, postings, "item_id", keys_from=train, row_id=["user_id"])
        .groupBy("user_id", "term")
        .agg(F.sum(F.col("weight") * F.col("x")).alias("v"))
    )
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("user_id")))
    return summed.select("user_id", "term", (F.col("v") / norm).alias("weight"))


def content_recs(
    train: DataFrame,
    catalog: DataFrame,
    users: DataFrame,
    index: TermIndex,
    k: int = 10,
    exclude_seen: bool = True,
) -> DataFrame:
    """Items closest to the user's content profile; users without one get popularity lists.

    The index alone decides the vocabulary.
    """
    places = cut_lineage(vocabulary_places(index))
    profiles = content_profiles(train, index)
    wanted = sparse_vectors(profiles, places, "user_id").join(
        users.select("user_id"), "user_id", "left_semi"
    )
    items = catalog.select("item_id").join(
        sparse_vectors(index.postings, places, "item_id"), "item_id", "left"
    )
    none_i, none_d = F.array().cast("array<int>"), F.array().cast("array<double>")
    items = items.withColumns({"idx": F.coalesce("idx", none_i), "val": F.coalesce("val", none_d)})
    exclude = user_history(train).withColumnRenamed("user_id", "query_id") if exclude_seen else None
    top = block_topk(
        wanted.withColumnRenamed("user_id", "query_id"), items, k, exclude=exclude
    ).withColumnRenamed("query_id", "user_id")
    others = users.select("user_id").join(wanted.select("user_id"), "user_id", "left_anti")
    return top.unionByName(popularity_recs(train, catalog, others, k, exclude_seen))


def profile_recs(profiles: DataFrame, users: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Category and brand matches plus rating terms; ranked by score, rating count, item id.

    A match only adds to the score, so an item outside the first k of its own (category, brand)
    cell, category, brand or the catalog cannot be in a list that this cell, category, brand or
    nothing matched. The first k of each of those groups are therefore enough for every user.
    """
    rated = items.select(
        "item_id",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("rating_count", F.lit(0)).alias("rating_count"),
        F.round(
            F.coalesce("avg_rating", F.lit(0.0)) / 5.0
            + F.log1p(F.coalesce("rating_count", F.lit(0)).cast("double")) / 10.0,
            SCORE_DIGITS,
        ).alias("base"),
    )
    star = F.lit("\u0000")
    cells = F.array(
        F.struct(F.col("category").alias("c"), F.col("brand").alias("b")),
        F.struct(F.col("category").alias("c"), star.alias("b")),
        F.struct(star.alias("c"), F.col("brand").alias("b")),
        F.struct(star.alias("c"), star.alias("b")),
    )
    best = Window.partitionBy("cell_c", "cell_b").orderBy(
        F.col("base").desc(), F.col("rating_count").desc(), "item_id"
    )
    lists = (
        rated.withColumn("cell", F.explode(cells))
        .select("*", F.col("cell.c").alias("cell_c"), F.col("cell.b").alias("cell_b"))
        .drop("cell")
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k)
        .drop("_n")
    )
    none = F.array().cast("array<string>")
    known = users.select("user_id").join(
        profiles.select("user_id", "top_categories", "top_brands"), "user_id", "left"
    )
    known = known.withColumns(
        {"top_categories": F.coalesce("top_categories", none), "top_brands": F.coalesce("top_brands", none)}
    )
    asked = (
        known.withColumn("cell_c", F.explode(F.concat("top_categories", F.array(star))))
        .withColumn("cell_b", F.explode(F.concat("top_brands", F.array(star))))
    )
    joined = skew.join(
        asked, lists, ["cell_c", "cell_b"], keys_from=asked, row_id=["user_id"], rows=100_000
    )
    score = (
        F.array_contains("top_categories", F.col("category")).cast("double")
        + F.array_contains("top_brands", F.col("brand")).cast("double")
        + F.col("base")
    )
    scored = joined.groupBy("user_id", "item_id", "rating_count").agg(
        F.max(F.round(score, SCORE_DIGITS)).alias("score")
    )
    order = Window.partitionBy("user_id").orderBy(
        F.col("score").desc(), F.col("rating_count").desc(), "item_id"
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("user_id", "item_id", "score", "rank")
    )


def top_values(rows: DataFrame, column: str, value: Column, n: int, out: str) -> DataFrame:
    """The ``n`` values of ``column`` with the largest total per user, as an ordered array."""
    totals = (
        rows.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy("user_id", column)
        .agg(F.sum(value).alias("_total"))
    )
    order = Window.partitionBy("user_id").orderBy(F.col("_total").desc(), column)
    listed = F.sort_array(F.collect_list(F.struct("_n", column)))
    return (
        totals.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
        .groupBy("user_id")
        .agg(listed[column].alias(out))
    )


def user_profile_summary(users: DataFrame, interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Counts, top three categories and brands by event count, mean weight; zeros if unknown."""
    per_pair = interactions.groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("event_weight", F.lit(1.0))).alias("w"),
    )
    rows = skew.join(
        per_pair, items.select("item_id", "category", "brand"), "item_id", "left",
        keys_from=interactions, row_id=["user_id"],
    )
    totals = per_pair.groupBy("user_id").agg(
        F.sum("n").alias("num_interactions"),
        F.count("*").alias("num_unique_items"),
        (F.sum("w") / F.sum("n")).alias("avg_event_weight"),
    )
    none = F.array().cast("array<string>")
    out = users.select("user_id").join(totals, "user_id", "left")
    for column, name in (("category", "top_categories"), ("brand", "top_brands")):
        out = out.join(top_values(rows, column, F.col("n"), 3, name), "user_id", "left")
    return out.select(
        "user_id",
        F.coalesce("num_interactions", F.lit(0)).alias("num_interactions"),
        F.coalesce("num_unique_items", F.lit(0)).alias("num_unique_items"),
        F.coalesce("top_categories", none).alias("top_categories"),
        F.coalesce("top_brands", none).alias("top_brands"),
        F.coalesce("avg_event_weight", F.lit(0.0)).alias("avg_event_weight"),
    )


def build_recommender(method: str, train: DataFrame, items: DataFrame, index: TermIndex | None = None, **settings):
    """A function (users, k) -> recommendations for the named method."""
    if method == "popularity":
        return lambda users, k=10: popularity_recs(train, items, users, k, **settings)
    if method == "itemcf":
        return lambda users, k=10: itemcf_recs(train, items, users, k, **settings)
    if method == "user_history_embedding":
        if index is None:
            raise ValueError("content recommendations need an item index")
        return lambda users, k=10: content_recs(train, items, users, index, k, **settings)
    if method == "matrix_factorization":
        model = mf_model(train, **settings)
        return lambda users, k=10: mf_recs(model, train, items, users, k)
    raise ValueError(f"unsupported recommendation method: {method}")
