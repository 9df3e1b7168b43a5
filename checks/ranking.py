"""Ranking feature, ranker and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle import skew
from aisle.operators import hybrid as h
from aisle.operators import ranking as k
from aisle.operators import retrieval as r
from aisle.operators.metrics import auc
from aisle.plans.rankers import build_ranker, load_ranker
from aisle.session import cut_lineage, scratch_dir
from checks.base import Inputs, check, cte, hashed_int_sql, tokens_sql
from checks.vectors import fused_topk_frame


def rounded(df, digits: int = 6):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


POPULARITY = """SELECT item_id, count(*) AS item_popularity_count, sum(event_weight) AS item_event_weight_sum,
 count(*) FILTER (event_type = 'purchase') AS item_purchase_count,
 count(*) FILTER (event_type = 'add_to_cart') AS item_add_to_cart_count FROM train GROUP BY 1"""
cte("item_pop", POPULARITY, "train")


@check("item_popularity", "SELECT * FROM item_pop", "item_pop")
def item_popularity(spark, sf):
    return k.item_popularity(Inputs(spark, sf).train)


CONVERSION = """(item_purchase_count + 0.5e0 * item_add_to_cart_count) / greatest(item_popularity_count, 1)"""


@check(
    "conversion_proxy",
    f"SELECT item_id, round({CONVERSION}, 6) AS conversion_proxy FROM item_pop",
    "item_pop",
)
def conversion_proxy(spark, sf):
    out = k.conversion_proxy(k.item_popularity(Inputs(spark, sf).train))
    return rounded(out.select("item_id", "conversion_proxy"))


cte(
    "proxies",
    f"""SELECT item_id, coalesce(item_popularity_count, 0) AS item_popularity_count,
 coalesce(item_event_weight_sum, 0) AS item_event_weight_sum, coalesce(item_purchase_count, 0) AS item_purchase_count,
 coalesce(item_add_to_cart_count, 0) AS item_add_to_cart_count, coalesce({CONVERSION}, 0) AS conversion_proxy
FROM (SELECT item_id FROM items) LEFT JOIN item_pop USING (item_id)""",
    "items",
    "item_pop",
)


@check(
    "business_proxies",
    "SELECT * REPLACE (round(conversion_proxy, 6) AS conversion_proxy) FROM proxies",
    "proxies",
)
def business_proxies(spark, sf):
    x = Inputs(spark, sf)
    return rounded(k.business_proxies(x.train, x.items))


cte(
    "ranked_all",
    """SELECT query_text, item_id, bm25_score, dense_score, score AS hybrid_score,
 row_number() OVER (PARTITION BY query_text ORDER BY bm25_score DESC, item_id) AS bm25_rank,
 row_number() OVER (PARTITION BY query_text ORDER BY dense_score DESC, item_id) AS dense_rank,
 row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS hybrid_rank FROM hybrid_all""",
    "hybrid_all",
)
_QT = "list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+'))"


def _hit(field):
    return f"CAST(list_has_any({_QT}, {tokens_sql(field)}) AS DOUBLE)"


def _share(field):
    return f"len(list_intersect({_QT}, list_distinct({tokens_sql(field)}))) / CAST(len({_QT}) AS DOUBLE)"


cte(
    "candidates",
    f"""SELECT p.query_id, p.query_text, p.split, p.target_item_id, r.item_id AS candidate_item_id,
 CAST(r.item_id = p.target_item_id AS INT) AS label,
 CASE WHEN hybrid_rank <= 50 THEN 'bm25+dense+hybrid' ELSE 'bm25+dense+hybrid+positive_forced' END AS candidate_source,
 bm25_score, dense_score, hybrid_score, bm25_rank, dense_rank, hybrid_rank,
 f.category_match, f.brand_match, f.title_token_overlap, f.description_token_overlap,
 f.query_length, f.item_title_length, f.item_description_length,
 CAST(item_popularity_count AS DOUBLE) AS item_popularity_count, item_event_weight_sum,
 CAST(item_purchase_count AS DOUBLE) AS item_purchase_count,
 CAST(item_add_to_cart_count AS DOUBLE) AS item_add_to_cart_count, avg_rating, rating_count,
 ln(1 + rating_count) AS log_rating_count, price,
 CASE WHEN price < 50 THEN 'low' WHEN price < 100 THEN 'mid' WHEN price < 200 THEN 'high' ELSE 'premium' END AS price_bucket,
 greatest(0, least(avg_rating / 5, 1)) * least(ln(1 + rating_count) / ln(5001), 1) AS authority_score,
 conversion_proxy, 1 / (1 + ln(1 + item_popularity_count)) AS cold_start_score,
 i.category AS diversity_category, i.category, i.brand
FROM pairs p JOIN ranked_all r ON r.query_text = p.query_text AND (hybrid_rank <= 50 OR r.item_id = p.target_item_id)
JOIN items i ON i.item_id = r.item_id JOIN proxies x ON x.item_id = r.item_id
JOIN (SELECT query_text, item_id, {_hit('category')} AS category_match, {_hit('brand')} AS brand_match,
  {_share('title')} AS title_token_overlap, {_share('description')} AS description_token_overlap,
  CAST(len({tokens_sql('query_text')}) AS DOUBLE) AS query_length,
  CAST(len({tokens_sql('title')}) AS DOUBLE) AS item_title_length,
  CAST(len({tokens_sql('description')}) AS DOUBLE) AS item_description_length
  FROM texts CROSS JOIN items) f ON f.query_text = p.query_text AND f.item_id = r.item_id""",
    "pairs",
    "texts",
    "ranked_all",
    "items",
    "proxies",
)


def candidate_frame(spark, sf):
    x = Inputs(spark, sf)
    return k.ranking_features(x.pairs, x.items, x.train, x.bm25, x.tfidf)


ROUND_ALL = "SELECT COLUMNS(c -> c NOT IN ({skip})), {rounded} FROM candidates"
DOUBLES = (
    "bm25_score dense_score hybrid_score title_token_overlap description_token_overlap "
    "log_rating_count authority_score conversion_proxy cold_start_score"
).split()


@check(
    "ranking_features",
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in DOUBLES) + ") FROM candidates",
    "candidates",
)
def ranking_features(spark, sf):
    return rounded(candidate_frame(spark, sf))


cte(
    "short_lists",
    """SELECT query_id, item_id, src, rank FROM pairs JOIN (
 SELECT query_text, item_id, 'bm25' AS src, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank
 FROM bm25_scores WHERE score > 0 QUALIFY rank <= 20
 UNION ALL SELECT query_text, item_id, 'dense', row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank
 FROM tfidf_scores WHERE score > 0 QUALIFY rank <= 20
 UNION ALL SELECT query_text, item_id, 'hybrid', row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank
 FROM hybrid_all WHERE score > 0 QUALIFY rank <= 20) USING (query_text)""",
    "pairs",
    "bm25_scores",
    "tfidf_scores",
    "hybrid_all",
)
cte(
    "listed_pool",
    """SELECT query_id, item_id, b, d, h, n <= 30 AS kept, is_target FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, item_id) AS n FROM (
  SELECT query_id, item_id, min({'p': CASE src WHEN 'hybrid' THEN 0 WHEN 'bm25' THEN 1 ELSE 2 END, 'r': rank}) AS first,
   bool_or(src = 'bm25') AS b, bool_or(src = 'dense') AS d, bool_or(src = 'hybrid') AS h,
   item_id = any_value(target_item_id) AS is_target
  FROM short_lists JOIN (SELECT query_id, target_item_id FROM pairs) USING (query_id) GROUP BY 1, 2))""",
    "short_lists",
)
cte(
    "forced_pool",
    """SELECT query_id, item_id, b, d, h, false AS f FROM listed_pool WHERE kept
UNION ALL SELECT query_id, target_item_id, coalesce(b, false), coalesce(d, false), coalesce(h, false), true
 FROM pairs p LEFT JOIN listed_pool l ON l.query_id = p.query_id AND l.item_id = p.target_item_id
 WHERE NOT coalesce(kept, false)""".replace("SELECT query_id, target", "SELECT p.query_id, target"),
    "listed_pool",
    "pairs",
)
cte(
    "drawn_pool",
    f"""SELECT query_id, place_item AS item_id FROM (
 SELECT *, lo + {hashed_int_sql('42', 'query_id', 'd')} % (hi - lo) AS r FROM (
  SELECT query_id, free, (d * free) // kk AS lo, ((d + 1) * free) // kk AS hi, d FROM (
   SELECT *, unnest(range(kk)) AS d FROM (
    SELECT query_id, least(10, 30 - held, n - held) AS kk, n - held AS free FROM (
     SELECT query_id, count(*) AS held FROM forced_pool GROUP BY 1), (SELECT count(*) AS n FROM items)) WHERE kk > 0)))
JOIN (SELECT query_id, item_id AS place_item, row_number() OVER (PARTITION BY query_id ORDER BY item_id) - 1 AS place
 FROM (SELECT query_id FROM forced_pool GROUP BY 1 HAVING count(*) < 30) CROSS JOIN (SELECT item_id FROM items)
 ANTI JOIN forced_pool USING (query_id, item_id)) USING (query_id) WHERE place = r""",
    "forced_pool",
    "items",
)


@check(
    "candidate_pool",
    """SELECT query_id, item_id AS candidate_item_id, concat_ws('+', CASE WHEN b THEN 'bm25' END,
 CASE WHEN d THEN 'dense' END, CASE WHEN h THEN 'hybrid' END, CASE WHEN f THEN 'positive_forced' END) AS candidate_source
FROM forced_pool
UNION ALL SELECT query_id, item_id, 'random_negative' FROM drawn_pool""",
    "forced_pool",
    "drawn_pool",
)
def candidate_pool(spark, sf):
    x = Inputs(spark, sf)
    texts = cut_lineage(r.distinct_texts(x.pairs))
    found = (
        cut_lineage(h.fused_search(x.fused, texts, 20).top),
        r.topk_texts(x.bm25, texts, 20, fill=False),
        r.topk_texts(x.tfidf, texts, 20, fill=False),
    )
    parts = skew.layout_parts(x.pairs, 60 * x.pairs.count())
    asked = x.pairs.select("query_id", "query_text").repartition(parts, "query_id")
    lists = [r.to_queries(top.select("query_text", "item_id", "rank"), asked) for top in found]
    return k.candidate_pool(x.pairs, x.items, *lists, pool=30, random_negatives=10)


@check(
    "candidate_stats",
    """SELECT split, count(*) AS num_queries, round(avg(p), 6) AS positive_coverage,
 round(avg(n), 6) AS avg_candidates_per_query
FROM (SELECT split, query_id, max(label) AS p, count(*) AS n FROM candidates GROUP BY 1, 2) GROUP BY 1""",
    "candidates",
)
def candidate_stats(spark, sf):
    return rounded(k.candidate_stats(candidate_frame(spark, sf)))


@check(
    "validate_candidates",
    """SELECT count(*) AS num_rows, 0 AS duplicate_pairs FROM candidates""",
    "candidates",
)
def validate_candidates(spark, sf):
    from aisle.operators.clean import validate_candidates as validate

    return validate(candidate_frame(spark, sf))


@check(
    "numeric_feature_columns",
    """SELECT unnest(['authority_score', 'avg_rating', 'bm25_rank', 'bm25_score', 'brand_match', 'category_match',
 'cold_start_score', 'conversion_proxy', 'dense_rank', 'dense_score', 'description_token_overlap',
 'hybrid_rank', 'hybrid_score', 'item_add_to_cart_count', 'item_description_length',
 'item_event_weight_sum', 'item_popularity_count', 'item_purchase_count', 'item_title_length',
 'log_rating_count', 'price', 'query_length', 'rating_count', 'title_token_overlap']) AS feature,
 count(*) AS num_rows FROM candidates GROUP BY 1""",
    "candidates",
)
def numeric_feature_columns(spark, sf):
    frame = candidate_frame(spark, sf)
    names = k.numeric_feature_columns(frame)
    total = frame.agg(F.count("*").alias("num_rows"))
    return total.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "num_rows")


STANDARD = ("bm25_score", "hybrid_score", "price", "log_rating_count", "bm25_rank")


@check(
    "standardize",
    "SELECT query_id, candidate_item_id, "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 5) + 0 AS {c}" for c in STANDARD)
    + " FROM candidates, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STANDARD)
    + " FROM candidates WHERE split = 'train')",
    "candidates",
)
def standardize(spark, sf):
    frame = candidate_frame(spark, sf)
    out = k.standardize(frame.where("split = 'train'"), frame, STANDARD)
    return out.select(
        "query_id", "candidate_item_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in STANDARD]
    )


def _mm(c):
    return f"""CASE WHEN max({c}) OVER q > min({c}) OVER q
 THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE 0 END"""


cte(
    "mixed",
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, candidate_item_id) AS model_rank FROM (
 SELECT *, round(0.65e0 * {_mm('hybrid_score')} + 0.15e0 * {_mm('authority_score')} + 0.10e0 * {_mm('conversion_proxy')}
  + 0.05e0 * diversity + 0.05e0 * {_mm('cold_start_score')}, 9) AS model_score FROM (
  SELECT *, 1e0 / row_number() OVER (PARTITION BY query_id, category ORDER BY hybrid_score DESC, candidate_item_id) AS diversity
  FROM candidates) WINDOW q AS (PARTITION BY query_id))""",
    "candidates",
)


@check(
    "mixed_rank",
    """SELECT query_id, candidate_item_id, round(diversity, 6) AS diversity_component,
 round(model_score, 6) AS model_score, model_rank FROM mixed""",
    "mixed",
)
def mixed_rank(spark, sf):
    out = k.mixed_rank(candidate_frame(spark, sf))
    return rounded(
        out.select("query_id", "candidate_item_id", "diversity_component", "model_score", "model_rank")
    )


def _scored(spark, sf, method):
    frame = candidate_frame(spark, sf)
    model = k.train_ranker(frame, method)
    return k.score_candidates(model, frame).select("query_id", "candidate_item_id", "split", "label", "model_score")


@check("linear_ranker")
def linear_ranker(spark, sf):
    return _scored(spark, sf, "linear")


@check("gbt_ranker")
def gbt_ranker(spark, sf):
    return _scored(spark, sf, "gbt")


@check("mlp_ranker")
def mlp_ranker(spark, sf):
    frame = candidate_frame(spark, sf)
    model = k.mlp_ranker(frame)
    return k.score_candidates(model, frame).select("query_id", "candidate_item_id", "split", "label", "model_score")


@check("pair_text_ranker")
def pair_text_ranker(spark, sf):
    x = Inputs(spark, sf)
    frame = candidate_frame(spark, sf)
    model = k.pair_text_ranker(frame, x.items)
    scored = k.score_pair_text(model, frame, x.items)
    return scored.select("query_id", "candidate_item_id", "split", "label", "model_score")


@check("train_ranker")
def train_ranker(spark, sf):
    frame = candidate_frame(spark, sf)
    model = k.train_ranker(frame, "linear")
    weights = [float(w) for w in model.stages[-1].coefficients]
    rows = list(zip(k.numeric_feature_columns(frame), weights))
    return spark.createDataFrame(rows, "feature string, coefficient double")


@check("score_candidates")
def score_candidates(spark, sf):
    from aisle.operators.metrics import auc, ranking_metrics

    frame = candidate_frame(spark, sf)
    scored = k.score_candidates(k.train_ranker(frame, "linear"), frame)
    summary = ranking_metrics(scored, ["split"], k_values=(10, 20))
    return summary.join(auc(scored, ["split"]), "split")


#: Fewer rounds than the registered models of these methods, whose facts do not depend on them.
FACT_SETTINGS = {"gbt": {"maxIter": 3}, "mlp": {"maxIter": 10}}


def _ranker_facts(method):
    """A score for each row in 0..1, an AUC above 0.7, the same scores after saving and loading."""

    def facts(spark, sf):
        x = Inputs(spark, sf)
        frame = candidate_frame(spark, sf)
        ranker = build_ranker(method, frame, x.items, **FACT_SETTINGS.get(method, {}))
        scored = cut_lineage(
            ranker.score(frame).select("query_id", "candidate_item_id", "split", "label", "model_score")
        )
        path = scratch_dir(spark, f"ranker-{method}")
        ranker.save(path)
        again = load_ranker(method, path, x.items).score(frame.where("split = 'test'"))
        keys = ["query_id", "candidate_item_id"]
        both = again.select(*keys, F.col("model_score").alias("_again")).join(scored, keys)
        same = both.agg(F.max(F.abs(F.col("model_score") - F.col("_again"))) < 1e-9).scalar()
        found = scored.groupBy("split").agg(
            F.count("*").alias("num_rows"),
            F.every(F.col("model_score").between(0.0, 1.0)).alias("in_range"),
        )
        return found.join(auc(scored, ["split"]), "split").select(
            "split", "num_rows", "in_range", (F.col("auc") > 0.7).alias("better_than_chance"), same.alias("reloaded")
        )

    return facts


for _method in ("linear", "gbt", "mlp", "cross_encoder"):
    check(
        f"{_method}_ranker_holds",
        """SELECT split, count(*) AS num_rows, true AS in_range, true AS better_than_chance, true AS reloaded
FROM candidates GROUP BY 1""",
        "candidates",
    )(_ranker_facts(_method))


cte(
    "pair_vocab",
    """SELECT term, row_number() OVER (ORDER BY n DESC, term) + 3 AS term_id FROM (
 SELECT term, sum(n) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term, n
  FROM (SELECT query_text, count(*) AS n FROM candidates WHERE split = 'train' GROUP BY 1)
  UNION ALL SELECT unnest(regexp_extract_all(lower(body), '[a-z0-9]+')), n
  FROM (SELECT candidate_item_id AS item_id, count(*) AS n FROM candidates WHERE split = 'train' GROUP BY 1)
  JOIN item_texts USING (item_id)) GROUP BY 1)""",
    "candidates",
    "item_texts",
)


def _ids_sql(source, key, text):
    return f"""SELECT {key}, list(coalesce(term_id, 3) ORDER BY pos) AS ids FROM (
 SELECT {key}, unnest(t) AS term, unnest(range(len(t))) AS pos
 FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS t FROM {source}))
LEFT JOIN pair_vocab USING (term) GROUP BY 1"""


@check(
    "pair_encode",
    f"""SELECT query_id, candidate_item_id, array_to_string(list_resize(
  list_concat([1], q.ids, [2], i.ids)[1:64], 64, 0), ' ') AS input_ids
FROM candidates JOIN ({_ids_sql('texts', 'query_text', 'query_text')}) q USING (query_text)
JOIN ({_ids_sql('item_texts', 'item_id', 'body')}) i ON i.item_id = candidate_item_id""",
    "candidates",
    "texts",
    "item_texts",
    "pair_vocab",
)
def pair_encode(spark, sf):
    x = Inputs(spark, sf)
    frame = candidate_frame(spark, sf)
    vocabulary = k.pair_vocabulary(frame.where("split = 'train'"), x.items)
    out = k.pair_encode(frame, x.items, vocabulary)
    return out.withColumn("input_ids", F.concat_ws(" ", F.transform("input_ids", lambda i: i.cast("string"))))


@check(
    "augment_scores",
    """SELECT query_id, candidate_item_id, round(coalesce(f.score, 0), 6) AS multimodal_score,
 coalesce(f.rank, (SELECT count(*) + 1 FROM items)) AS multimodal_rank
FROM candidates c LEFT JOIN fused_top f ON f.query_text = c.query_text AND f.item_id = c.candidate_item_id""",
    "candidates",
    "fused_top",
    "items",
)
def augment_scores(spark, sf):
    x = Inputs(spark, sf)
    size = x.items.agg(F.count("*")).scalar()
    out = k.augment_scores(candidate_frame(spark, sf), fused_topk_frame(spark, sf), size)
    return rounded(out.select("query_id", "candidate_item_id", "multimodal_score", "multimodal_rank"))


@check(
    "top_candidates",
    """SELECT query_id, candidate_item_id, round(hybrid_score, 6) AS hybrid_score, hybrid_rank,
 row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, hybrid_rank, candidate_item_id) AS candidate_rank
FROM candidates QUALIFY candidate_rank <= 20""",
    "candidates",
)
def top_candidates(spark, sf):
    out = k.top_candidates(candidate_frame(spark, sf), 20)
    return rounded(out.select("query_id", "candidate_item_id", "hybrid_score", "hybrid_rank", "candidate_rank"))
