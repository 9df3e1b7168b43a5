"""Inverted-index retrieval: BM25, TF-IDF, their fusion and an overlap re-rank.

An index is a few lazy tables hash-partitioned by item. Lists of the best k items come from blocks of items
that distinct query texts stream past (``matching``). Where every matching pair is asked for, the terms of
few texts are broadcast, so scores add up inside the item partitions; more texts join on the term.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.scores import SCORE_DIGITS
from aisle.functions.text import ITEM_TEXT_FIELDS, item_text, token_overlap, tokenize
from aisle.operators.matching import best_matches


@dataclass
class TermIndex:
    """Weighted postings (item_id, term, weight), term weights (term, idf) and the item ids."""

    postings: DataFrame
    terms: DataFrame
    item_ids: DataFrame
    query_weighting: str
    normalize: bool = False

    def persist(self) -> TermIndex:
        self.postings = self.postings.persist()
        self.terms = self.terms.persist()
        return self


def term_counts(
    items: DataFrame,
    fields: Sequence[str] = ITEM_TEXT_FIELDS,
    field_weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """(item_id, term, tf), laid out by item so that later per-item work needs no shuffle."""
    present = [f for f in fields if f in items.columns]
    placed = items.select("item_id", *present).repartition("item_id")
    if not field_weights:
        tokens = placed.select("item_id", F.explode(tokenize(item_text(present))).alias("term"))
        return tokens.groupBy("item_id", "term").agg(F.count("*").cast("double").alias("tf"))
    weighted = []
    for name in present:
        weight = float(field_weights.get(name, 1.0))
        if weight > 0:
            words = F.coalesce(tokenize(F.col(name).cast("string")), F.array().cast("array<string>"))
            weighted.append(F.transform(words, _with_weight(weight)))
    return (
        placed.select("item_id", F.explode(F.concat(*weighted)).alias("x"))
        .groupBy("item_id", F.col("x.term").alias("term"))
        .agg(F.sum("x.w").alias("tf"))
    )


def _with_weight(weight: float):
    return lambda term: F.struct(term.alias("term"), F.lit(weight).alias("w"))


def bm25_index(
    items: DataFrame,
    k1: float = 1.5,
    b: float = 0.75,
    fields: Sequence[str] = ITEM_TEXT_FIELDS,
    field_weights: Mapping[str, float] | None = None,
) -> TermIndex:
    counts = term_counts(items, fields, field_weights)
    ids = items.select("item_id")
    total = ids.agg(F.count("*").cast("double")).scalar()
    mean_length = counts.agg(F.sum("tf")).scalar() / total
    length = F.sum("tf").over(Window.partitionBy("item_id"))
    postings = counts.withColumn("dl", length).select(
        "item_id",
        "term",
        "tf",
        "dl",
        (
            F.col("tf")
            * F.lit(k1 + 1.0)
            / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / mean_length))
        ).alias("weight"),
    )
    df = F.col("df").cast("double")
    terms = (
        counts.groupBy("term")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", F.log(F.lit(1.0) + (total - df + 0.5) / (df + 0.5)))
    )
    return TermIndex(postings, terms, ids, "count")


def tfidf_index(
    items: DataFrame,
    max_features: int = 5000,
    normalize: bool = True,
    fields: Sequence[str] = ITEM_TEXT_FIELDS,
) -> TermIndex:
    """TF-IDF over the ``max_features`` most frequent terms; at most that many, so broadcast."""
    counts = term_counts(items, fields)
    ids = items.select("item_id")
    total = F.greatest(ids.agg(F.count("*").cast("double")).scalar(), F.lit(1.0))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    if max_features > 0:
        terms = terms.orderBy(F.col("df").desc(), "term").limit(max_features)
    terms = terms.withColumn("idf", F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0)
    vocabulary = terms.select("term", "idf")
    vocabulary = F.broadcast(vocabulary) if 0 < max_features <= skew.BROADCAST_ROWS else vocabulary
    postings = _weigh(counts.join(vocabulary, "term"), "item_id", normalize)
    return TermIndex(postings, terms, ids, "tfidf", normalize)


def _weigh(counts: DataFrame, key: str, normalize: bool) -> DataFrame:
    """Term share times idf per ``key``, scaled to unit length when asked."""
    per_key = Window.partitionBy(key)
    raw = counts.withColumn(
        "weight", F.col("tf") / F.sum("tf").over(per_key) * F.col("idf")
    )
    if normalize:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(per_key))
        raw = raw.withColumn("weight", F.col("weight") / norm)
    return raw.select(key, "term", "weight")


def query_terms(texts: DataFrame) -> DataFrame:
    return (
        texts.select("query_text", F.explode(tokenize("query_text")).alias("term"))
        .groupBy("query_text", "term")
        .agg(F.count("*").cast("double").alias("tf"))
    )


def encode_queries(index: TermIndex, texts: DataFrame) -> DataFrame:
    """(query_text, term, weight) in the vocabulary of the index."""
    known = query_terms(texts).join(index.terms.select("term", "idf"), "term")
    if index.query_weighting == "count":
        return known.select("query_text", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    return _weigh(known, "query_text", index.normalize)


def matched_scores(index: TermIndex, texts: DataFrame, score: str = "score") -> DataFrame:
    """Score of every (query_text, item) pair that shares a term; all other pairs score 0."""
    wanted = encode_queries(index, texts).withColumnRenamed("weight", "_qw")
    postings = index.postings.select("item_id", "term", "weight")
    if skew.fits_broadcast(query_terms(texts)):
        pairs = postings.join(F.broadcast(wanted), "term")
    else:
        pairs = skew.join(postings, wanted, "term", hot=frequent_terms(index), row_id=["item_id"])
    return pairs.groupBy("query_text", "item_id").agg(
        F.round(F.sum(F.col("_qw") * F.col("weight")), SCORE_DIGITS).alias(score)
    )


def frequent_terms(index: TermIndex) -> DataFrame | None:
    """Terms whose postings are too many for one task; the index already counted them."""
    counted = index.terms.select("term", F.col("df").alias("_rows"))
    return skew.hot_of_counts(counted, skew.hot_rows(index.terms))


def distinct_texts(queries: DataFrame) -> DataFrame:
    return queries.select("query_text").distinct()


def best_first(key: str, score: str, k: int, df: DataFrame, item: str = "item_id") -> DataFrame:
    """Rows ranked per key by score down, then item id; only the first ``k`` are kept."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fill_with_zeros(
    top: DataFrame,
    texts: DataFrame,
    item_ids: DataFrame,
    k: int,
    zero_columns: Sequence[str],
    keys: Sequence[str] = ("query_text",),
) -> DataFrame:
    """Lists shorter than ``k`` completed by the first unmatched item ids with score 0.

    At most m of the first k ids are matched by a list of m, so k ids suffice for every query.
    """
    names = list(keys)
    sizes = top.groupBy(*names).agg(F.count("*").alias("_m"))
    short = (
        texts.join(sizes, names, "left")
        .withColumn("_m", F.coalesce("_m", F.lit(0)))
        .where(F.col("_m") < k)
    )
    first_ids = item_ids.orderBy("item_id").limit(k)
    listed = first_ids.agg(F.array_sort(F.collect_list("item_id"))).scalar()
    spare = short.withColumn("item_id", F.explode(listed)).join(
        top.select(*names, "item_id"), [*names, "item_id"], "left_anti"
    )
    order = Window.partitionBy(*names).orderBy("item_id")
    filler = (
        spare.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= k - F.col("_m"))
        .select(
            *names,
            "item_id",
            *[F.lit(0.0).alias(c) for c in zero_columns],
            (F.col("_m") + F.col("_n")).cast("int").alias("rank"),
        )
    )
    return top.select(*names, "item_id", *zero_columns, "rank").unionByName(filler)


def to_queries(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results per text handed to every query id with that text, however many share it.

    Few results are sent to all tasks, so queries stay where they are.
    """
    if skew.fits_broadcast(results):
        return queries.join(F.broadcast(results), "query_text")
    return skew.join(queries, results, "query_text", keys_from=queries, row_id=["query_id"])


def topk_texts(index: TermIndex, texts: DataFrame, k: int = 50, fill: bool = True) -> DataFrame:
    top = best_matches(
        index.postings.select("item_id", "term", "weight"), encode_queries(index, texts), k, index.item_ids.count()
    )
    return fill_with_zeros(top, texts, index.item_ids, k, ["score"]) if fill else top


def topk(index: TermIndex, queries: DataFrame, k: int = 50, fill: bool = True) -> DataFrame:
    """Ranked items per query (query_id, query_text, item_id, score, rank)."""
    results = topk_texts(index, distinct_texts(queries), k, fill)
    return to_queries(results, queries.select("query_id", "query_text"))


bm25_topk = topk
tfidf_topk = topk


def minmax_normalize(
    scores: DataFrame, score: str, catalog_size: Column | None, out: str, key: str = "query_text"
) -> DataFrame:
    """Per-query min-max where pairs that are not listed count as zero; constant lists give 0."""
    listed = F.count("*") if catalog_size is None else F.when(
        F.count("*") >= F.max(catalog_size), F.count("*")
    )
    stats = scores.groupBy(key).agg(
        F.max(score).alias("_max"),
        F.when(listed.isNotNull(), F.min(score)).otherwise(F.lit(0.0)).alias("_min"),
    )
    joined = skew.join(scores, stats, key)
    span = F.col("_max") - F.col("_min")
    value = F.when(span > 0, (F.col(score) - F.col("_min")) / span).otherwise(F.lit(0.0))
    return joined.withColumn(out, value).drop("_max", "_min")


def hybrid_scores(
    bm25: TermIndex,
    tfidf: TermIndex,
    texts: DataFrame,
    bm25_weight: float = 0.5,
    dense_weight: float = 0.5,
    normalization: str = "minmax",
) -> DataFrame:
    """(query_text, item_id, bm25_score, dense_score, score) for pairs that match at all.

    Both scores are added up side by side in one aggregation instead of an outer join.
    """
    if normalization not in ("minmax", "none", "raw"):
        raise ValueError(f"unsupported normalization: {normalization}")
    zero = F.lit(0.0)
    left = matched_scores(bm25, texts, "bm25_score").withColumn("dense_score", zero)
    right = matched_scores(tfidf, texts, "dense_score").withColumn("bm25_score", zero)
    both = (
        left.unionByName(right)
        .groupBy("query_text", "item_id")
        .agg(F.sum("bm25_score").alias("bm25_score"), F.sum("dense_score").alias("dense_score"))
    )
    if normalization == "minmax":
        total = bm25.item_ids.agg(F.count("*")).scalar()
        stats = both.groupBy("query_text").agg(
            F.count("*").alias("_n"),
            F.max("bm25_score").alias("_bmax"),
            F.min("bm25_score").alias("_bmin"),
            F.max("dense_score").alias("_dmax"),
            F.min("dense_score").alias("_dmin"),
        )
        both = skew.join(both, stats, "query_text", row_id=["item_id"])
        full = F.col("_n") >= total

        def scaled(score: str, low: str, high: str) -> Column:
            least = F.when(full, F.col(low)).otherwise(zero)
            span = F.col(high) - least
            return F.when(span > 0, (F.col(score) - least) / span).otherwise(zero)

        parts = scaled("bm25_score", "_bmin", "_bmax"), scaled("dense_score", "_dmin", "_dmax")
    else:
        parts = F.col("bm25_score"), F.col("dense_score")
    blended = F.lit(bm25_weight) * parts[0] + F.lit(dense_weight) * parts[1]
    return both.select(
        "query_text",
        "item_id",
        "bm25_score",
        "dense_score",
        F.round(blended, SCORE_DIGITS).alias("score"),
    )


# Default weights of the overlap re-rank.
RERANK_WEIGHTS = {
    "bm25": 1.0,
    "title_overlap": 0.0,
    "category_overlap": 0.0,
    "brand_overlap": 0.0,
    "description_overlap": 0.0,
    "rating": 0.0,
    "popularity": 0.0,
}


def overlap_rerank(
    index: TermIndex,
    items: DataFrame,
    queries: DataFrame,
    k: int = 50,
    pool: int = 100,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """BM25 pool re-ordered by a weighted sum of overlap, rating and popularity features."""
    w = {**RERANK_WEIGHTS, **(weights or {})}
    texts = distinct_texts(queries)
    size = max(k, pool)
    candidates = topk_texts(index, texts, size).withColumnRenamed("score", "bm25_score")
    per_query = Window.partitionBy("query_text")
    low, high = F.min("bm25_score").over(per_query), F.max("bm25_score").over(per_query)
    span = high - low
    count = F.log1p(F.coalesce(F.col("rating_count"), F.lit(0)).cast("double"))
    top_count = items.agg(F.greatest(F.max(count), F.lit(1.0))).scalar()
    details = items.select(
        "item_id",
        *ITEM_TEXT_FIELDS,
        (F.coalesce("avg_rating", F.lit(0.0)) / 5.0).alias("rating"),
        (count / top_count).alias("popularity"),
    )
    words = tokenize("query_text")
    featured = (
        skew.join(candidates, details, "item_id")
        .withColumn("bm25", F.when(span > 0, (F.col("bm25_score") - low) / span).otherwise(0.0))
        .select(
            "query_text",
            "item_id",
            "bm25_score",
            "bm25",
            *[token_overlap(words, f).alias(f"{f}_overlap") for f in ITEM_TEXT_FIELDS],
            "rating",
            "popularity",
        )
    )
    total = sum((F.lit(float(w[name])) * F.col(name) for name in w), F.lit(0.0))
    scored = featured.withColumn("score", F.round(total, SCORE_DIGITS))
    order = per_query.orderBy(F.col("score").desc(), F.col("bm25_score").desc(), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return to_queries(ranked, queries.select("query_id", "query_text"))


def text_fallback_search(requests: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Token-overlap search: share of query tokens in the item text, then rating, then id.

    Matching items come from a join on the token; only lists left short see other items, taken
    from the k best-rated ones of the catalog.
    """
    texts = distinct_texts(requests)
    one = F.lit(1.0).alias("weight")
    terms = query_terms(texts).select("query_text", "term", one)
    sizes = terms.groupBy("query_text").agg(F.count("*").alias("_terms"))
    rated = items.select("item_id", F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"))
    # an item listed several times counts by its best rating until its rows are joined again
    ratings = rated.groupBy("item_id").agg(F.max("avg_rating").alias("avg_rating"))
    item_terms = term_counts(items).select("item_id", "term", one).join(ratings, "item_id")
    found = best_matches(item_terms, terms, k, items.count(), tie="avg_rating")
    scored = found.join(sizes, "query_text").select(
        "query_text", "item_id", (F.col("score") / F.col("_terms")).alias("score")
    )
    matched = skew.join(scored, rated, "item_id")
    order = Window.partitionBy("query_text").orderBy(
        F.col("score").desc(), F.col("avg_rating").desc(), "item_id"
    )
    top = matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best_rated = rated.orderBy(F.col("avg_rating").desc(), "item_id").limit(k)
    listed = best_rated.agg(
        F.collect_list(F.struct("avg_rating", "item_id"))
    ).scalar()
    counts = top.groupBy("query_text").agg(F.count("*").alias("_m"))
    short = (
        texts.join(counts, "query_text", "left")
        .withColumn("_m", F.coalesce("_m", F.lit(0)))
        .where(F.col("_m") < k)
        .withColumn("x", F.explode(listed))
        .select("query_text", "_m", F.col("x.item_id").alias("item_id"), "x.avg_rating")
        .join(top.select("query_text", "item_id"), ["query_text", "item_id"], "left_anti")
    )
    rest = Window.partitionBy("query_text").orderBy(F.col("avg_rating").desc(), "item_id")
    filler = (
        short.withColumn("_n", F.row_number().over(rest))
        .where(F.col("_n") <= k - F.col("_m"))
        .select(
            "query_text",
            "item_id",
            F.lit(0.0).alias("score"),
            "avg_rating",
            (F.col("_m") + F.col("_n")).cast("int").alias("rank"),
        )
    )
    results = top.select("query_text", "item_id", "score", "avg_rating", "rank").unionByName(filler)
    return to_queries(results, requests.select("query_id", "query_text"))
