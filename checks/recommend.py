"""Recommender queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aisle.operators import recommend as rec
from checks.base import Inputs, check, cte, flat


@check("user_history", "SELECT DISTINCT user_id, item_id FROM inter", "inter")
def user_history(spark, sf):
    return rec.user_history(Inputs(spark, sf).interactions)


cte(
    "weights",
    "SELECT user_id, item_id, sum(event_weight) AS weight FROM train GROUP BY 1, 2",
    "train",
)


@check("user_item_weights", "SELECT user_id, item_id, weight FROM weights", "weights")
def user_item_weights(spark, sf):
    return rec.user_item_weights(Inputs(spark, sf).train)


@check(
    "user_item_weights_orders",
    "SELECT user_id, item_id, sum(event_weight) AS weight FROM order_inter GROUP BY 1, 2",
    "order_inter",
)
def user_item_weights_orders(spark, sf):
    return rec.user_item_weights(Inputs(spark, sf).orders)


cte("active", "SELECT DISTINCT user_id FROM inter", "inter")
cte(
    "popular",
    """SELECT item_id, coalesce(s, 0) AS pop
FROM items LEFT JOIN (SELECT item_id, sum(event_weight) AS s FROM train GROUP BY 1) USING (item_id)""",
    "items",
    "train",
)


def unseen_top(score_cte: str, users: str = "users", k: int = 10) -> str:
    """Top unseen catalog items for scores that cover some (user, item) pairs."""
    return f"""SELECT user_id, item_id, round(score, 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT user_id, item_id, CASE WHEN known THEN coalesce(s.score, 0) ELSE pop END AS score
  FROM (SELECT user_id, user_id IN (SELECT user_id FROM {score_cte}) AS known FROM {users})
  CROSS JOIN popular LEFT JOIN {score_cte} s USING (user_id, item_id)
  ANTI JOIN train USING (user_id, item_id))) WHERE rank <= {k}"""


@check(
    "popularity_recs",
    """SELECT user_id, item_id, round(pop, 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pop DESC, item_id) AS rank
 FROM users CROSS JOIN popular ANTI JOIN train USING (user_id, item_id)) WHERE rank <= 10""",
    "users",
    "popular",
    "train",
)
def popularity_recs(spark, sf):
    x = Inputs(spark, sf)
    return rec.popularity_recs(x.train, x.items, x.users, 10)


def similarity_cte(name: str, weights: str, neighbors: int) -> None:
    cte(
        name,
        f"""SELECT item_i, item_j, sim FROM (
 SELECT *, row_number() OVER (PARTITION BY item_j ORDER BY sim DESC, item_i) AS n FROM (
  SELECT a.item_id AS item_i, b.item_id AS item_j, round(sum(a.w * b.w), 9) AS sim
  FROM {name}_u a JOIN {name}_u b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  GROUP BY 1, 2)) WHERE n <= {neighbors}""",
        f"{name}_u",
    )
    cte(
        f"{name}_u",
        f"""SELECT user_id, item_id, weight / norm AS w FROM {weights}
JOIN (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM {weights} GROUP BY 1) USING (item_id)""",
        weights,
    )


similarity_cte("sims", "weights", 50)
cte(
    "order_weights",
    "SELECT user_id, item_id, sum(event_weight) AS weight FROM order_inter GROUP BY 1, 2",
    "order_inter",
)
similarity_cte("order_sims", "order_weights", 50)


@check(
    "itemcf_similarity",
    "SELECT item_i, item_j, round(sim, 6) AS similarity FROM sims",
    "sims",
)
def itemcf_similarity(spark, sf):
    sims = rec.itemcf_similarity(Inputs(spark, sf).train)
    return sims.withColumn("similarity", F.round("similarity", 6))


@check(
    "itemcf_similarity_orders",
    "SELECT item_i, item_j, round(sim, 6) AS similarity FROM order_sims",
    "order_sims",
)
def itemcf_similarity_orders(spark, sf):
    sims = rec.itemcf_similarity(Inputs(spark, sf).orders)
    return sims.withColumn("similarity", F.round("similarity", 6))


cte(
    "itemcf_scores",
    """SELECT user_id, item_i AS item_id, round(sum(sim * weight), 9) AS score
FROM weights JOIN sims ON item_id = item_j GROUP BY 1, 2""",
    "weights",
    "sims",
)


@check("itemcf_recs", unseen_top("itemcf_scores"), "itemcf_scores", "users", "popular", "train")
def itemcf_recs(spark, sf):
    x = Inputs(spark, sf)
    recs = rec.itemcf_recs(x.train, x.items, x.users, 10)
    return recs.withColumn("score", F.round("score", 6))


@check("rank_unseen", unseen_top("rated", "active", 20), "rated", "active", "popular", "train")
def rank_unseen(spark, sf):
    x = Inputs(spark, sf)
    rated = x.interactions.where("rating >= 4").groupBy("user_id", "item_id").agg(
        F.sum("rating").alias("score")
    )
    active = x.interactions.select("user_id").distinct()
    return rec.with_popularity(rated, x.train, x.items, active, 20, True)


cte(
    "rated",
    "SELECT user_id, item_id, sum(rating) AS score FROM inter WHERE rating >= 4 GROUP BY 1, 2",
    "inter",
)
cte(
    "content_scores",
    """SELECT user_id, item_id, round(sum(p.v / n.norm * i.w), 9) AS score
FROM content_profile p JOIN (SELECT user_id, sqrt(sum(v * v)) AS norm FROM content_profile GROUP BY 1) n
  USING (user_id) JOIN item_weights i USING (term) GROUP BY 1, 2""",
    "content_profile",
    "item_weights",
)
cte(
    "content_profile",
    """SELECT user_id, term, sum(weight * w) AS v FROM weights JOIN item_weights USING (item_id)
GROUP BY 1, 2""",
    "weights",
    "item_weights",
)


@check("content_recs", unseen_top("content_scores"), "content_scores", "users", "popular", "train")
def content_recs(spark, sf):
    x = Inputs(spark, sf)
    recs = rec.content_recs(x.train, x.items, x.users, x.tfidf, 10)
    return recs.withColumn("score", F.round("score", 6))


@check("mf_recs")
def mf_recs(spark, sf):
    x = Inputs(spark, sf)
    model = rec.mf_model(x.train)
    return rec.mf_recs(model, x.train, x.items, x.users, 10)


def list_facts(recs, train):
    """What every list must hold whatever a model has learned."""
    per_user = Window.partitionBy("user_id").orderBy("rank")
    seen = train.select("user_id", "item_id").distinct().withColumn("seen", F.lit(1))
    rows = recs.join(seen, ["user_id", "item_id"], "left").withColumn("before", F.lag("score").over(per_user))
    per_list = rows.groupBy("user_id").agg(
        F.count("*").alias("n"),
        ((F.max("rank") == F.count("*")) & (F.count_distinct("rank", "item_id") == F.count("*"))).alias("complete"),
        F.count("seen").alias("seen"),
        F.count_if(F.col("before") < F.col("score")).alias("rising"),
    )
    return per_list.agg(
        F.count("*").alias("users"),
        F.sum("n").alias("listed"),
        F.every("complete").alias("ranks_complete"),
        (F.sum("seen") == 0).alias("unseen_only"),
        (F.sum("rising") == 0).alias("ordered"),
    )


FACTS = """SELECT count(*) AS users, CAST(sum(least(10, n - coalesce(s, 0))) AS BIGINT) AS listed,
 true AS ranks_complete, true AS unseen_only, true AS ordered
FROM {0} LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS s FROM train GROUP BY 1) USING (user_id),
 (SELECT count(*) AS n FROM items)"""


@check("mf_recs_hold", FACTS.format("users"), "users", "train", "items")
def mf_recs_hold(spark, sf):
    return list_facts(mf_recs(spark, sf), Inputs(spark, sf).train)


@check(
    "seq_item2vec_recs_hold",
    FACTS.format("(SELECT DISTINCT user_id FROM train JOIN users USING (user_id))"),
    "users",
    "train",
    "items",
)
def seq_item2vec_recs_hold(spark, sf):
    from aisle.operators import sequence as seq

    x = Inputs(spark, sf)
    recs = seq.seq_item2vec_recs(seq.train_item2vec(x.train), x.train, x.items, x.users, 10)
    return list_facts(recs, x.train)


SUMMARY = """SELECT u.user_id, count(event_id) AS num_interactions, count(DISTINCT item_id) AS num_unique_items,
 coalesce(any_value(tc), '') AS top_categories, coalesce(any_value(tb), '') AS top_brands,
 round(coalesce(avg(event_weight), 0), 6) AS avg_event_weight
FROM users u LEFT JOIN inter USING (user_id)
LEFT JOIN ({0}) c ON c.user_id = u.user_id LEFT JOIN ({1}) b ON b.user_id = u.user_id GROUP BY 1"""
TOP3 = """SELECT user_id, string_agg({0}, '|' ORDER BY n DESC, {0}) AS {1} FROM (
 SELECT user_id, {0}, count(*) AS n FROM inter JOIN items USING (item_id) GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {0}) <= 3) GROUP BY 1"""


@check(
    "user_profile_summary",
    SUMMARY.format(TOP3.format("category", "tc"), TOP3.format("brand", "tb")),
    "users",
    "inter",
    "items",
)
def user_profile_summary(spark, sf):
    x = Inputs(spark, sf)
    out = rec.user_profile_summary(x.users, x.interactions, x.items)
    return out.select(
        "user_id", "num_interactions", "num_unique_items", flat("top_categories"), flat("top_brands"),
        F.round("avg_event_weight", 6).alias("avg_event_weight"),
    )


PROFILE_TOP3 = """SELECT user_id, list({0} ORDER BY n DESC, {0}) AS {1} FROM (
 SELECT user_id, {0}, sum(event_weight) AS n FROM train JOIN items USING (item_id) GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {0}) <= 3) GROUP BY 1"""
cte("user_cats", PROFILE_TOP3.format("category", "cats"), "train", "items")
cte("user_brands", PROFILE_TOP3.format("brand", "brands"), "train", "items")


@check(
    "profile_recs",
    """SELECT user_id, item_id, round(score, 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rating_count DESC, item_id) AS rank
 FROM (SELECT user_id, item_id, rating_count, round(
   coalesce(list_contains(cats, category), false)::INT + coalesce(list_contains(brands, brand), false)::INT
   + round(avg_rating / 5 + ln(1 + rating_count) / 10, 9), 9) AS score
  FROM users LEFT JOIN user_cats USING (user_id) LEFT JOIN user_brands USING (user_id) CROSS JOIN items))
WHERE rank <= 10""",
    "users",
    "user_cats",
    "user_brands",
    "items",
)
def profile_recs(spark, sf):
    from aisle.operators.profiles import behavior_summary

    x = Inputs(spark, sf)
    profiles = behavior_summary(x.train, x.items)
    recs = rec.profile_recs(profiles, x.users, x.items, 10)
    return recs.withColumn("score", F.round("score", 6))
