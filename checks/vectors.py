"""Vector search, item representation and user profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import profiles as p
from aisle.operators import representation as rep
from aisle.operators import retrieval as r
from aisle.operators import vector_index as vi
from aisle.operators import vectors as v
from aisle.session import cut_lineage, scratch_dir
from checks.base import Inputs, check, cte, flat


def _vectors(spark, sf):
    table = Inputs(spark, sf).table("embeddings")
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    items = table.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return queries, items


cte(
    "units",
    """SELECT vec_id, list_transform(e, lambda x: x / n) AS vec FROM (
 SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
)


@check(
    "vector_topk",
    """SELECT query_id, item_id, round(score, 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.vec, b.vec), 9) AS score
  FROM units a CROSS JOIN units b)) WHERE rank <= 10""",
    "units",
)
def vector_topk(spark, sf):
    out = v.vector_topk(*_vectors(spark, sf), k=10)
    return out.withColumn("score", F.round("score", 6))


def _loaded_index(spark, sf, k):
    """An index built over all items, saved and read back, and the queries."""
    queries, items = _vectors(spark, sf)
    path = scratch_dir(spark, "vector-index")
    vi.save_vector_index(vi.build_vector_index(items, k), path)
    return vi.load_vector_index(spark, path), queries, items


@check("ann_topk")
def ann_topk(spark, sf):
    index, queries, _ = _loaded_index(spark, sf, 10)
    return vi.ann_topk(index, queries, k=10)


@check(
    "ann_topk_recall",
    """SELECT count(*) AS queries, CAST(sum(least(50, (SELECT count(*) FROM embeddings))) AS BIGINT) AS listed,
 true AS ranks_complete, true AS scores_exact, true AS recall_reached FROM embeddings""",
)
def ann_topk_recall(spark, sf):
    """Lists of a saved and loaded index: full, with exact scores, recall at 50 of 0.9 or more."""
    index, queries, items = _loaded_index(spark, sf, 50)
    found = cut_lineage(vi.ann_topk(index, queries, 50))
    exact = cut_lineage(v.vector_topk(queries, items, 50))
    both = found.join(exact.withColumnsRenamed({"score": "true", "rank": "_r"}), ["query_id", "item_id"], "left")
    per_query = both.groupBy("query_id").agg(
        F.count("*").alias("n"),
        (F.max("rank") == F.count_distinct("rank")).alias("complete"),
        F.max(F.abs(F.col("score") - F.coalesce("true", "score"))).alias("off"),
        F.count("true").alias("hits"),
    )
    return per_query.agg(
        F.count("*").alias("queries"),
        F.sum("n").alias("listed"),
        F.every("complete").alias("ranks_complete"),
        (F.max("off") < 1e-8).alias("scores_exact"),
        (F.sum("hits") >= 0.9 * F.lit(exact.count())).alias("recall_reached"),
    )


@check("text_vectors", "SELECT item_id, term, round(w, 6) AS weight FROM item_weights", "item_weights")
def text_vectors(spark, sf):
    index = rep.text_vectors(Inputs(spark, sf).items)
    return index.postings.withColumn("weight", F.round("weight", 6))


cte(
    "meta",
    """SELECT item_id, 'price' AS feature, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS value FROM items
UNION ALL SELECT item_id, 'avg_rating', (avg_rating - avg(avg_rating) OVER ()) / stddev_samp(avg_rating) OVER () FROM items
UNION ALL SELECT item_id, 'rating_count', (rating_count - avg(rating_count) OVER ()) / stddev_samp(rating_count) OVER () FROM items
UNION ALL SELECT item_id, 'log_rating_count', (ln(1 + rating_count) - avg(ln(1 + rating_count)) OVER ())
  / stddev_samp(ln(1 + rating_count)) OVER () FROM items
UNION ALL SELECT item_id, 'category=' || category, 1 FROM items
UNION ALL SELECT item_id, 'brand=' || brand, 1 FROM items""",
    "items",
)


@check("metadata_vectors", "SELECT item_id, feature, round(value, 6) + 0 AS value FROM meta", "meta")
def metadata_vectors(spark, sf):
    out = rep.metadata_vectors(Inputs(spark, sf).items)
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _with_images(spark, sf):
    x = Inputs(spark, sf)
    images = x.table("embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("image_embedding")
    )
    return x.items.join(images, "item_id", "left")


cte("images", "SELECT item_id, vec FROM items JOIN units ON item_id = vec_id", "items", "units")


@check(
    "image_vectors",
    """SELECT item_id, i, round(x, 6) + 0 AS value FROM (
 SELECT item_id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM images)""",
    "images",
)
def image_vectors(spark, sf):
    out = rep.image_vectors(_with_images(spark, sf))
    long = out.select("item_id", F.posexplode("vec").alias("i", "value"))
    return long.withColumn("value", F.round("value", 6) + F.lit(0.0))


@check(
    "image_available_rate",
    """SELECT round((SELECT count(*) FROM images) / (SELECT count(*) FROM items), 6) AS image_available_rate""",
    "images",
    "items",
)
def image_available_rate(spark, sf):
    out = rep.image_available_rate(_with_images(spark, sf))
    return out.withColumn("image_available_rate", F.round("image_available_rate", 6))


@check(
    "hash_vectors",
    """SELECT item_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM (
 SELECT item_id, i, CAST(CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT) AS DOUBLE) / 255 AS x FROM (
  SELECT item_id, sha256(CAST(item_id AS VARCHAR)) AS h, unnest(range(8)) AS i FROM items))""",
    "items",
)
def hash_vectors(spark, sf):
    out = rep.hash_vectors(Inputs(spark, sf).items)
    return out.select("item_id", F.posexplode("vec").alias("i", "value")).withColumn(
        "value", F.round("value", 6)
    )


cte(
    "fused",
    """SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM (
 SELECT item_id, 'text:' || term AS feature, 0.7e0 * w AS value FROM item_weights
 UNION ALL SELECT item_id, 'meta:' || feature, 0.2e0 * value FROM meta
 UNION ALL SELECT item_id, 'image:' || lpad(CAST(i AS VARCHAR), 5, '0'), 0.1e0 * x FROM (
  SELECT item_id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM images))""",
    "item_weights",
    "meta",
    "images",
)


def _fused(spark, sf):
    items = _with_images(spark, sf)
    text = rep.text_vectors(items)
    fused = rep.fuse_vectors(
        text.postings, rep.metadata_vectors(items), rep.image_vectors(items), 0.7, 0.2, 0.1
    )
    return items, text, fused


@check("fuse_vectors", "SELECT item_id, feature, round(value, 6) + 0 AS value FROM fused", "fused")
def fuse_vectors(spark, sf):
    _, _, fused = _fused(spark, sf)
    return fused.withColumn("value", F.round("value", 6) + F.lit(0.0))


cte(
    "fused_scores",
    """SELECT query_text, item_id, round(sum(q.w * f.value), 9) AS score
FROM query_weights q JOIN fused f ON f.feature = 'text:' || q.term GROUP BY 1, 2""",
    "query_weights",
    "fused",
)
cte(
    "fused_top",
    """SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank FROM (
 SELECT query_text, item_id, coalesce(score, 0) AS score FROM texts CROSS JOIN (SELECT item_id FROM items)
 LEFT JOIN fused_scores USING (query_text, item_id)) QUALIFY rank <= 50""",
    "texts",
    "items",
    "fused_scores",
)


def fused_topk_frame(spark, sf, k=50):
    items, text, fused = _fused(spark, sf)
    index = rep.fused_index(items, fused, text)
    return r.topk(index, Inputs(spark, sf).pairs, k)


@check(
    "fused_topk",
    """SELECT query_id, item_id, round(score, 6) AS score, rank FROM pairs JOIN fused_top USING (query_text)""",
    "pairs",
    "fused_top",
)
def fused_topk(spark, sf):
    top = fused_topk_frame(spark, sf)
    return top.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@check(
    "item_embeddings",
    """SELECT item_id, (SELECT count(DISTINCT feature) FROM fused) AS embedding_dim,
 round(sum(value * place), 4) AS moment, 'multimodal_fusion' AS method, true AS has_text_features,
 true AS has_metadata_features
FROM fused JOIN (SELECT feature, row_number() OVER (ORDER BY feature) AS place
  FROM (SELECT DISTINCT feature FROM fused)) USING (feature) GROUP BY 1""",
    "fused",
)
def item_embeddings(spark, sf):
    items, _, fused = _fused(spark, sf)
    out = rep.item_embeddings(items, fused, "multimodal_fusion")
    moment = F.aggregate(
        F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(
        "item_id", "embedding_dim", F.round(moment, 4).alias("moment"), "method",
        "has_text_features", "has_metadata_features",
    )


COUNTED = """SELECT item_id, count(event_id) AS interaction_count FROM items LEFT JOIN train USING (item_id)
GROUP BY 1"""
cte("counted", COUNTED, "items", "train")
COLD = """SELECT item_id, interaction_count FROM counted
WHERE interaction_count <= (SELECT quantile_cont(interaction_count, {0}) FROM counted)"""
cte("cold", COLD.format("0.25"), "counted")


@check("cold_start_items", COLD.format("0.25"), "counted")
def cold_start_items(spark, sf):
    x = Inputs(spark, sf)
    return rep.cold_start_items(x.items, x.train)


@check("long_tail_items", COLD.format("0.97"), "counted")
def long_tail_items(spark, sf):
    x = Inputs(spark, sf)
    return rep.long_tail_items(x.items, x.train, 0.97)


@check(
    "flag_cold_start",
    """SELECT item_id, interaction_count <= (SELECT quantile_cont(interaction_count, 0.25) FROM counted) AS is_cold_start,
 interaction_count <= (SELECT quantile_cont(interaction_count, 0.97) FROM counted) AS is_long_tail FROM counted""",
    "counted",
)
def flag_cold_start(spark, sf):
    x = Inputs(spark, sf)
    out = rep.flag_cold_start(x.items, x.train, 0.25, 0.97)
    return out.select("item_id", "is_cold_start", "is_long_tail")


cte(
    "summary",
    """SELECT user_id, count(*) AS history_length, avg(price) AS avg_price,
 count(*) FILTER (event_type = 'purchase') AS purchase_count,
 count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart_count,
 count(*) FILTER (event_type = 'click') AS click_count,
 count(*) FILTER (event_type = 'view') AS view_count,
 string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS behavior_signals,
 any_value(cats) AS cats, any_value(brands) AS brands, any_value(recents) AS recents
FROM train JOIN items USING (item_id) JOIN user_cats USING (user_id) JOIN user_brands USING (user_id)
JOIN (SELECT user_id, string_agg(title, '|' ORDER BY b DESC) AS recents FROM (
  SELECT user_id, title, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC) AS b
  FROM train JOIN items USING (item_id)) WHERE b <= 5 GROUP BY 1) USING (user_id)
GROUP BY 1""",
    "train",
    "items",
    "user_cats",
    "user_brands",
)
PREFERENCE = """CASE WHEN avg_price IS NULL THEN 'unknown' WHEN avg_price < 50 THEN 'budget'
 WHEN avg_price < 150 THEN 'mid_range' ELSE 'premium' END"""


@check(
    "behavior_summary",
    f"""SELECT user_id, history_length, round(avg_price, 6) AS avg_price, purchase_count, add_to_cart_count,
 click_count, view_count, behavior_signals, array_to_string(cats, '|') AS top_categories,
 array_to_string(brands, '|') AS top_brands, recents AS recent_interests, {PREFERENCE} AS price_preference
FROM summary""",
    "summary",
)
def behavior_summary(spark, sf):
    x = Inputs(spark, sf)
    out = p.behavior_summary(x.train, x.items)
    return out.select(
        "user_id", "history_length", F.round("avg_price", 6).alias("avg_price"),
        *[f"{e}_count" for e in p.EVENT_TYPES], "price_preference",
        *[flat(c) for c in ("behavior_signals", "top_categories", "top_brands", "recent_interests")],
    )


cte(
    "profiles",
    f"""SELECT *, array_to_string(cats[1:2], ', ') AS c2, 'Interests: ' || array_to_string(cats[1:2], ', ') || '. Brands: '
 || array_to_string(brands[1:2], ', ') || '. Price preference: ' || {PREFERENCE} || '.' AS profile_text FROM summary""",
    "summary",
)


@check(
    "user_profile",
    """SELECT user_id, profile_text, 'User shows interest in ' || c2
 || ', based only on observed synthetic product interactions.' AS summary, 0.85e0 AS confidence FROM profiles""",
    "profiles",
)
def user_profile(spark, sf):
    x = Inputs(spark, sf)
    out = p.user_profile(p.behavior_summary(x.train, x.items))
    return out.select("user_id", "profile_text", "summary", "confidence")


@check(
    "read_profiles",
    """SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'Likes "' || c2 || '"' ELSE
  'Profile based only on observed synthetic product interactions.' END AS summary,
 CASE user_id % 4 WHEN 0 THEN '12' ELSE profile_text END AS profile_text,
 CASE user_id % 4 WHEN 0 THEN 'A|7|None' WHEN 1 THEN '' ELSE array_to_string(cats, '|') END AS top_categories,
 array_to_string(brands, '|') AS top_brands, CASE user_id % 4 WHEN 0 THEN 0.5e0 ELSE 0e0 END AS confidence,
 user_id % 4 IN (0, 1) AS schema_valid FROM profiles""",
    "profiles",
)
def read_profiles(spark, sf):
    """Profiles from plain, mistyped, cut off and missing outputs of all users."""
    x = Inputs(spark, sf)
    summary = p.behavior_summary(x.train, x.items)
    plain = F.to_json(
        F.struct(
            F.concat(F.lit('Likes "'), F.array_join(F.slice("top_categories", 1, 2), ", "), F.lit('"')).alias("summary"),
            F.lit(12).alias("profile_text"),
            F.lit(" ").alias("price_preference"),
        )
    )
    full = F.concat(
        F.substring(plain, 1, F.length(plain) - 1),
        F.lit(', "top_categories": ["A", 7, " ", null], "top_brands": "Nova", "confidence": "0.5"}'),
    )
    odd = F.lit('```json\n{"summary": null, "top_categories": [], "confidence": "high"}\n```')
    output = F.array(full, odd, F.substring(full, 1, 30))[(F.col("user_id") % 4).cast("int")]
    answers = summary.where("user_id % 4 < 3").select("user_id", output.alias("output_text"))
    out = p.read_profiles(summary, answers)
    lists = [flat(c) for c in ("top_categories", "top_brands")]
    return out.select("user_id", "summary", "profile_text", *lists, "confidence", "schema_valid")


@check(
    "profile_vectors",
    """SELECT user_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY user_id)), 6) AS weight FROM (
 SELECT user_id, term, CAST(count(*) AS DOUBLE) AS n FROM (
  SELECT user_id, unnest(regexp_extract_all(lower(profile_text), '[a-z0-9]+')) AS term FROM profiles)
 GROUP BY 1, 2)""",
    "profiles",
)
def profile_vectors(spark, sf):
    x = Inputs(spark, sf)
    profiles = p.user_profile(p.behavior_summary(x.train, x.items))
    return p.profile_vectors(profiles).withColumn("weight", F.round("weight", 6))
