"""Source, cleaning, split, text and query-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.functions import query_rules as rules
from aisle.functions import scores
from aisle.functions import text as t
from aisle.operators import clean, phrases, queries as q, splits
from aisle.plans import dataset
from aisle.session import scratch_dir
from aisle.sources import files
from checks.base import (
    Inputs,
    check,
    cte,
    flat,
    hashed_int_sql,
    intent_sql,
    norm_sql,
    tokens_sql,
)


@check(
    "scan_parquet",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def scan_parquet(spark, sf):
    orders = files.scan_parquet(spark, f"{sf}/orders.parquet")
    return orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


SPLIT_SQL = "SELECT event_id, user_id, item_id, split FROM loo"


@check("sink_parquet", SPLIT_SQL, "loo")
def sink_parquet(spark, sf):
    path = scratch_dir(spark, "sink")
    files.sink_parquet(Inputs(spark, sf).split, path, ["split"])
    return files.scan_parquet(spark, path).select("event_id", "user_id", "item_id", "split")


PRICE_COUNTS = "SELECT category AS method, split, count(*) AS num_queries FROM pairs GROUP BY 1, 2"


def _counts(spark, sf):
    pairs = Inputs(spark, sf).pairs
    return pairs.groupBy(F.col("category").alias("method"), "split").agg(
        F.count("*").alias("num_queries")
    )


@check("scan_results_csv", PRICE_COUNTS, "pairs")
def scan_results_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    counts = _counts(spark, sf)
    counts.write.mode("overwrite").option("header", True).csv(path)
    return files.scan_results_csv(spark, path, counts.schema)


@check(
    "upsert_results",
    """SELECT category AS method, split,
 CASE WHEN split = 'test' THEN count(*) * 10 ELSE count(*) END AS num_queries
FROM pairs GROUP BY category, split""",
    "pairs",
)
def upsert_results(spark, sf):
    old = _counts(spark, sf)
    new = old.where("split = 'test'").withColumn("num_queries", F.col("num_queries") * 10)
    return files.upsert_results(old, new, ["method", "split"])


@check("scan_candidate_source", SPLIT_SQL, "loo")
def scan_candidate_source(spark, sf):
    base = scratch_dir(spark, "candidates")
    files.sink_parquet(Inputs(spark, sf).split, base)
    found = files.scan_candidate_source(spark, base + "-augmented-missing", base)
    return found.select("event_id", "user_id", "item_id", "split")


@check("scan_optional", "SELECT user_id, user_region FROM users", "users")
def scan_optional(spark, sf):
    users = Inputs(spark, sf).users.select("user_id", "user_region")
    absent = files.scan_optional(spark, scratch_dir(spark, "optional") + "/none", users.schema)
    return users.unionByName(absent)


@check(
    "build_dataset",
    """SELECT 'users' AS output, count(*) AS num_rows FROM users u
  WHERE EXISTS (SELECT 1 FROM inter WHERE inter.user_id = u.user_id)
UNION ALL SELECT 'items', count(*) FROM items i
  WHERE EXISTS (SELECT 1 FROM inter WHERE inter.item_id = i.item_id)
UNION ALL SELECT 'train', count(*) FROM train
UNION ALL SELECT 'val', count(*) FROM loo WHERE split = 'val'
UNION ALL SELECT 'test', count(*) FROM test
UNION ALL SELECT 'user_sequences', count(DISTINCT user_id) FROM inter
UNION ALL SELECT 'negative_samples', sum(least(5, n - s))::BIGINT FROM inter
  JOIN (SELECT user_id, count(DISTINCT item_id) AS s FROM inter
        GROUP BY 1) USING (user_id), (SELECT count(DISTINCT item_id) AS n FROM inter)""",
    "users",
    "items",
    "train",
    "test",
)
def build_dataset(spark, sf):
    x = Inputs(spark, sf)
    path = scratch_dir(spark, "dataset")
    built = dataset.build_dataset(x.users, x.items, x.interactions, path)
    parts = [
        frame.agg(F.count("*").alias("num_rows")).withColumn("output", F.lit(name))
        for name, frame in built.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check(
    "require_columns",
    "SELECT count(*) AS num_rows, count(title) AS titled FROM items",
    "items",
)
def require_columns(spark, sf):
    items = clean.require_columns(Inputs(spark, sf).items, clean.ITEM_COLUMNS, "items")
    return items.agg(F.count("*").alias("num_rows"), F.count("title").alias("titled"))


@check(
    "clean_items",
    """SELECT part_id AS item_id, coalesce(min(title), '') AS title,
 coalesce(any_value(category), 'Unknown') AS category, coalesce(any_value(brand), 'Unknown') AS brand,
 any_value(price) AS price, any_value(rating_count) AS rating_count,
 coalesce(min(description), '') AS description
FROM (SELECT item_id AS part_id, title, nullif(category, 'Electronics') AS category,
  nullif(brand, 'Nova') AS brand, price, rating_count, nullif(description, '') AS description
  FROM items) GROUP BY 1""",
    "items",
)
def clean_items(spark, sf):
    items = Inputs(spark, sf).items
    gaps = items.withColumn("category", F.nullif("category", F.lit("Electronics"))).withColumn(
        "brand", F.nullif("brand", F.lit("Nova"))
    )
    dirty = gaps.unionByName(gaps).unionByName(
        gaps.withColumn("item_id", F.lit(None).cast("long"))
    )
    columns = ["item_id", "title", "category", "brand", "price", "rating_count", "description"]
    return clean.clean_items(dirty).select(*columns)


@check(
    "clean_users",
    """SELECT user_id, coalesce(nullif(user_age_bucket, 'BUILDING'), 'Unknown') AS user_age_bucket,
 user_region FROM users""",
    "users",
)
def clean_users(spark, sf):
    users = Inputs(spark, sf).users
    dirty = users.withColumn("user_age_bucket", F.nullif("user_age_bucket", F.lit("BUILDING")))
    return clean.clean_users(dirty.unionByName(dirty))


@check(
    "clean_interactions",
    """SELECT event_id, user_id, item_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts,
 event_type, CASE WHEN event_type = 'click' THEN 0e0 ELSE rating END AS rating, event_weight
FROM inter""",
    "inter",
)
def clean_interactions(spark, sf):
    raw = Inputs(spark, sf).interactions
    dirty = (
        raw.withColumn("timestamp", F.col("timestamp").cast("string"))
        .withColumn("rating", F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("rating").cast("string")))
        .withColumn("event_weight", F.lit(9.0))
    )
    broken = dirty.withColumn("timestamp", F.lit("not a time"))
    cleaned = clean.clean_interactions(dirty.unionByName(dirty).unionByName(broken))
    return cleaned.select(
        "event_id", "user_id", "item_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "event_type", "rating", "event_weight",
    )


@check(
    "event_weight",
    """SELECT event_type, CASE event_type WHEN 'view' THEN 1e0 WHEN 'click' THEN 2e0
 WHEN 'add_to_cart' THEN 3e0 WHEN 'purchase' THEN 4e0 ELSE 1e0 END AS event_weight, count(*) AS n
FROM events GROUP BY 1, 2""",
)
def event_weight(spark, sf):
    events = Inputs(spark, sf).table("events")
    return events.groupBy("event_type", clean.event_weight("event_type").alias("event_weight")).agg(
        F.count("*").alias("n")
    )


MIN_SQL = """SELECT event_id, user_id, item_id FROM (
 SELECT *, count(*) OVER (PARTITION BY item_id) AS ni FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS nu FROM inter) WHERE nu >= 50) WHERE ni >= 40"""


@check("min_count_filter", MIN_SQL, "inter")
def min_count_filter(spark, sf):
    x = Inputs(spark, sf)
    _, _, kept = clean.min_count_filter(x.users, x.items, x.interactions, 50, 40)
    return kept.select("event_id", "user_id", "item_id")


@check(
    "validate_query_pairs",
    """SELECT count(*) AS num_pairs, 0 AS duplicate_query_ids, 0 AS invalid_splits,
 0 AS invalid_labels FROM pairs""",
    "pairs",
)
def validate_query_pairs(spark, sf):
    return clean.validate_query_pairs(Inputs(spark, sf).pairs)


@check(
    "filter_split",
    "SELECT event_id, user_id, item_id FROM loo WHERE split = 'val'",
    "loo",
)
def filter_split(spark, sf):
    return clean.filter_split(Inputs(spark, sf).split, "val").select("event_id", "user_id", "item_id")


@check("attach_split", SPLIT_SQL, "loo")
def attach_split(spark, sf):
    split = Inputs(spark, sf).split
    parts = [split.where(F.col("split") == s).drop("split") for s in clean.SPLITS]
    return clean.attach_split(*parts).select("event_id", "user_id", "item_id", "split")


@check(
    "ensure_columns",
    "SELECT user_id, user_region, CAST(NULL AS VARCHAR) AS nickname FROM users",
    "users",
)
def ensure_columns(spark, sf):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("user_id", T.LongType()),
            T.StructField("user_region", T.StringType()),
            T.StructField("nickname", T.StringType()),
        ]
    )
    return clean.ensure_columns(Inputs(spark, sf).users, schema)


@check("leave_one_out", SPLIT_SQL, "loo")
def leave_one_out(spark, sf):
    return Inputs(spark, sf).split.select("event_id", "user_id", "item_id", "split")


ISO = """CASE WHEN strftime("timestamp", '%f') = '000000' THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
 ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') END"""
SEQ_ORDER = 'ORDER BY "timestamp", item_id, event_id'


@check(
    "user_sequences",
    f"""SELECT user_id, string_agg(CAST(item_id AS VARCHAR), '|' {SEQ_ORDER}) AS item_sequence,
 string_agg({ISO}, '|' {SEQ_ORDER}) AS timestamp_sequence,
 string_agg(event_type, '|' {SEQ_ORDER}) AS event_type_sequence,
 sum(event_weight) AS total_weight, count(*) AS sequence_length FROM inter GROUP BY 1""",
    "inter",
)
def user_sequences(spark, sf):
    seq = splits.user_sequences(Inputs(spark, sf).interactions)
    return seq.select(
        "user_id",
        flat("item_sequence"),
        flat("timestamp_sequence"),
        flat("event_type_sequence"),
        F.aggregate("event_weight_sequence", F.lit(0.0), lambda a, v: a + v).alias("total_weight"),
        "sequence_length",
    )


cte("catalog", "SELECT item_id, row_number() OVER (ORDER BY item_id) AS item_idx FROM items", "items")


@check("item_index", "SELECT item_id, item_idx FROM catalog", "catalog")
def item_index(spark, sf):
    x = Inputs(spark, sf)
    return splits.item_index(x.items, x.interactions)


@check(
    "encode_interactions",
    "SELECT event_id, user_id, item_idx FROM inter JOIN catalog USING (item_id)",
    "inter",
    "catalog",
)
def encode_interactions(spark, sf):
    x = Inputs(spark, sf)
    index = splits.item_index(x.items, x.interactions)
    return splits.encode_interactions(x.interactions, index).select("event_id", "user_id", "item_idx")


cte(
    "train_pos",
    f"""SELECT user_id, item_id, item_idx, row_number() OVER (PARTITION BY user_id {SEQ_ORDER}) AS position
FROM train JOIN catalog USING (item_id)""",
    "train",
    "catalog",
)


@check(
    "prefix_examples",
    """SELECT t.user_id, t.position, any_value(t.item_idx) AS target_id,
 array_to_string(list_concat(list_resize([]::BIGINT[], greatest(0, 20 - count(*))::BIGINT, 0),
   list(p.item_idx ORDER BY p.position)[greatest(1, count(*) - 19):]), '|') AS input_ids,
 array_to_string(list_sort(list_distinct(list(p.item_idx))), '|') AS seen_ids
FROM train_pos t JOIN train_pos p ON p.user_id = t.user_id AND p.position < t.position
GROUP BY 1, 2""",
    "train_pos",
)
def prefix_examples(spark, sf):
    x = Inputs(spark, sf)
    index = splits.item_index(x.items, x.interactions)
    out = splits.prefix_examples(x.train, index)
    return out.select("user_id", "position", "target_id", flat("input_ids"), flat("seen_ids"))


@check(
    "eval_examples",
    """SELECT user_id, array_to_string(list_concat(
   list_resize([]::BIGINT[], greatest(0, 20 - count(*))::BIGINT, 0),
   list(item_idx ORDER BY position)[greatest(1, count(*) - 19):]), '|') AS input_ids,
 array_to_string(list_sort(list_distinct(list(item_idx))), '|') AS seen_ids,
 any_value(target_ids) AS target_ids
FROM train_pos JOIN (SELECT user_id, string_agg(DISTINCT item_idx, '|' ORDER BY item_idx) AS target_ids
  FROM test JOIN catalog USING (item_id) GROUP BY 1) USING (user_id) GROUP BY 1""",
    "train_pos",
    "test",
    "catalog",
)
def eval_examples(spark, sf):
    x = Inputs(spark, sf)
    index = splits.item_index(x.items, x.interactions)
    out = splits.eval_examples(x.train, x.test, index)
    return out.select("user_id", flat("input_ids"), flat("seen_ids"), flat("target_ids"))


@check(
    "pad_left",
    """SELECT user_id, array_to_string(list_concat(
   list_resize([]::BIGINT[], greatest(0, 64 - len(s))::BIGINT, 0), s[greatest(1, len(s) - 63):]), '|') AS padded
FROM (SELECT user_id, list(item_id ORDER BY "timestamp", item_id, event_id) AS s FROM inter GROUP BY 1)""",
    "inter",
)
def pad_left(spark, sf):
    seq = splits.user_sequences(Inputs(spark, sf).interactions)
    return seq.select("user_id", splits.pad_left(F.col("item_sequence"), 64).alias("padded")).select(
        "user_id", flat("padded")
    )


@check(
    "negative_sampling",
    f"""SELECT event_id, user_id, item_id AS positive_item_id, split, d AS draw, free_item AS negative_item_id
FROM (SELECT *, lo + {hashed_int_sql('42', 'user_id', 'item_id', 'event_id', 'd')} % (hi - lo) AS r FROM (
  SELECT *, (d * free) // k AS lo, ((d + 1) * free) // k AS hi FROM (
   SELECT *, least(5, free) AS k, unnest(range(least(5, free))) AS d FROM loo
   JOIN (SELECT user_id, count(*) AS free FROM unseen GROUP BY 1) USING (user_id))))
JOIN (SELECT user_id, item_id AS free_item, n FROM unseen) USING (user_id)
WHERE n = r""",
    "loo",
    "unseen",
)
def negative_sampling(spark, sf):
    x = Inputs(spark, sf)
    return splits.negative_sampling(x.split, x.items)


@check(
    "uniform_negative_ids",
    f"""SELECT event_id, target_id, draw,
 CASE WHEN v >= target_id AND n > 1 THEN v + 1 ELSE v END AS negative_id
FROM (SELECT *, {hashed_int_sql('42', 'event_id', 'draw')} % greatest(n - 1, 1) + 1 AS v FROM (
 SELECT event_id, item_idx AS target_id, unnest(range(1, 21)) AS draw FROM inter JOIN catalog USING (item_id)),
 (SELECT count(*) AS n FROM items))""",
    "inter",
    "catalog",
    "items",
)
def uniform_negative_ids(spark, sf):
    x = Inputs(spark, sf)
    index = splits.item_index(x.items, x.interactions)
    rows = splits.encode_interactions(x.interactions, index).select(
        "event_id", F.col("item_idx").alias("target_id")
    )
    count = index.agg(F.count("*")).scalar()
    return splits.uniform_negative_ids(rows, count, 20, ["event_id"])


cte(
    "unseen",
    """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS n
FROM (SELECT DISTINCT user_id FROM inter) CROSS JOIN (SELECT item_id FROM items)
ANTI JOIN inter USING (user_id, item_id)""",
    "inter",
    "items",
)


@check(
    "query_split",
    f"""SELECT event_id, CASE WHEN d < 80 THEN 'train' WHEN d < 90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT event_id, {hashed_int_sql('42', 'event_id')} % 100 AS d FROM events)""",
)
def query_split(spark, sf):
    events = Inputs(spark, sf).table("events")
    return events.select("event_id", splits.query_split("event_id").alias("split"))


# Text functions run over whole documents and benchmark texts.


@check("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized FROM documents")
def normalize_text(spark, sf):
    docs = Inputs(spark, sf).table("documents")
    return docs.select("doc_id", F.md5(t.normalize_text("text")).alias("normalized"))


@check(
    "tokenize",
    f"SELECT doc_id, len({tokens_sql('text')}) AS n, md5(array_to_string({tokens_sql('text')}, ' ')) AS tokens FROM documents",
)
def tokenize(spark, sf):
    docs = Inputs(spark, sf).table("documents")
    words = t.tokenize("text")
    return docs.select("doc_id", F.size(words).alias("n"), F.md5(F.concat_ws(" ", words)).alias("tokens"))


@check(
    "item_text",
    f"SELECT item_id, {norm_sql('body')} AS item_text FROM item_texts",
    "item_texts",
)
def item_text(spark, sf):
    return Inputs(spark, sf).items.select("item_id", t.item_text().alias("item_text"))


@check(
    "bag_of_words",
    f"""SELECT query_id, term, row_number() OVER () * 0 + count(*) AS n, any_value(idx) AS idx FROM (
 SELECT query_id, unnest({tokens_sql('query_text')}) AS term FROM pairs)
JOIN (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (
  SELECT DISTINCT unnest({tokens_sql('query_text')}) AS term FROM pairs WHERE split = 'train')) USING (term)
GROUP BY query_id, term""".replace("row_number() OVER () * 0 + ", ""),
    "pairs",
)
def bag_of_words(spark, sf):
    pairs = Inputs(spark, sf).pairs
    vocabulary = q.bag_of_words_vocabulary(pairs.where("split = 'train'"), "query_text")
    return q.bag_of_words(pairs, vocabulary, "query_id", "query_text")


_QT = "list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+'))"


def _ov(field):
    f = f"list_distinct(regexp_extract_all(lower({field}), '[a-z0-9]+'))"
    return f"round(CASE WHEN len({_QT}) > 0 THEN len(list_intersect({_QT}, {f})) / CAST(len({_QT}) AS DOUBLE) ELSE 0 END, 6)"


@check(
    "token_overlap",
    f"SELECT query_id, {_ov('description')} AS overlap FROM pairs JOIN items ON target_item_id = item_id",
    "pairs",
    "items",
)
def token_overlap(spark, sf):
    x = Inputs(spark, sf)
    joined = x.pairs.join(
        x.items.select(F.col("item_id").alias("target_item_id"), "description"), "target_item_id"
    )
    overlap = t.token_overlap(t.tokenize("query_text"), "description")
    return joined.select("query_id", F.round(overlap, 6).alias("overlap"))


@check(
    "text_match_features",
    f"""SELECT query_id, CAST(list_has_any({_QT}, {tokens_sql('i.category')}) AS DOUBLE) AS category_match,
 CAST(list_has_any({_QT}, {tokens_sql('i.brand')}) AS DOUBLE) AS brand_match,
 {_ov('title')} AS title_token_overlap, {_ov('description')} AS description_token_overlap,
 CAST(len({tokens_sql('query_text')}) AS DOUBLE) AS query_length,
 CAST(len({tokens_sql('title')}) AS DOUBLE) AS item_title_length,
 CAST(len({tokens_sql('description')}) AS DOUBLE) AS item_description_length
FROM pairs JOIN items i ON target_item_id = i.item_id""",
    "pairs",
    "items",
)
def text_match_features(spark, sf):
    from aisle.operators.ranking import text_match_features as features

    x = Inputs(spark, sf)
    items = x.items.withColumnRenamed("item_id", "target_item_id")
    joined = x.pairs.drop("category", "brand").join(items, "target_item_id")
    out = joined.select("query_id", *features())
    for c in ("title_token_overlap", "description_token_overlap"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@check(
    "price_bucket",
    """SELECT item_id, CASE WHEN price < 50 THEN 'low' WHEN price < 100 THEN 'mid'
 WHEN price < 200 THEN 'high' ELSE 'premium' END AS price_bucket FROM items""",
    "items",
)
def price_bucket(spark, sf):
    return Inputs(spark, sf).items.select("item_id", scores.price_bucket("price").alias("price_bucket"))


@check(
    "authority_score",
    """SELECT item_id, round(greatest(0, least(avg_rating / 5, 1)) * least(ln(1 + rating_count) / ln(5001), 1), 6)
 AS authority_score FROM items""",
    "items",
)
def authority_score(spark, sf):
    value = F.round(scores.authority_score("avg_rating", "rating_count"), 6)
    return Inputs(spark, sf).items.select("item_id", value.alias("authority_score"))


@check(
    "cold_start_score",
    """SELECT item_id, round(1 / (1 + ln(1 + count(event_id))), 6) AS cold_start_score
FROM items LEFT JOIN train USING (item_id) GROUP BY 1""",
    "items",
    "train",
)
def cold_start_score(spark, sf):
    x = Inputs(spark, sf)
    counts = x.train.groupBy("item_id").agg(F.count("*").alias("n"))
    value = F.round(scores.cold_start_score("n"), 6)
    return x.items.join(counts, "item_id", "left").select("item_id", value.alias("cold_start_score"))


@check(
    "price_preference",
    """SELECT item_id, CASE WHEN price < 50 THEN 'budget' WHEN price < 150 THEN 'mid_range'
 ELSE 'premium' END AS price_preference FROM items""",
    "items",
)
def price_preference(spark, sf):
    return Inputs(spark, sf).items.select(
        "item_id", scores.price_preference("price").alias("price_preference")
    )


@check(
    "query_price_label",
    """SELECT item_id, CASE WHEN price < 30 THEN 'budget' WHEN price >= 120 THEN 'premium'
 ELSE 'affordable' END AS price_label FROM items""",
    "items",
)
def query_price_label(spark, sf):
    return Inputs(spark, sf).items.select("item_id", q.query_price_label("price").alias("price_label"))


cte(
    "rule_texts",
    """SELECT 'd' || doc_id AS id, text FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'q' || query_id, query_text FROM pairs
UNION ALL SELECT 'u' || item_id, category || ' under $' || price || '  ' || title FROM items""",
    "pairs",
    "items",
)


def rule_texts(spark, sf):
    """Whole documents, conversation turns, generated queries and priced item lines."""
    x = Inputs(spark, sf)

    def part(df, key, text):
        return df.select(key.alias("id"), text.alias("text"))

    lines = F.concat_ws("", "category", F.lit(" under $"), "price", F.lit("  "), "title")
    parts = [
        part(x.table("documents"), F.concat(F.lit("d"), "doc_id"), F.col("text")),
        part(x.table("conversations"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), F.col("text")),
        part(x.pairs, F.concat(F.lit("q"), "query_id"), F.col("query_text")),
        part(x.items, F.concat(F.lit("u"), "item_id"), lines),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@check("classify_intent", f"SELECT id, {intent_sql('text')} AS intent FROM rule_texts", "rule_texts")
def classify_intent(spark, sf):
    return rule_texts(spark, sf).select("id", rules.classify_intent("text").alias("intent"))


def price_sql(x):
    n = norm_sql(x)
    words = "".join(
        f" WHEN regexp_matches({n}, '\\b{w}\\b') THEN '{w}'" for w in ("affordable", "budget", "cheap", "premium")
    )
    amount = f"regexp_extract({n}, '\\bunder\\s+\\$?(\\d+(?:\\.\\d+)?)\\b', 1)"
    return f"CASE WHEN {amount} <> '' THEN 'under_' || replace({amount}, '.', '_'){words} END"


def use_case_sql(x):
    n = norm_sql(x)
    phrases = "beginner,gym,running,travel,dry skin,walking,outdoor,office,school,gift".split(",")
    whens = "".join(f" WHEN regexp_matches({n}, '\\b{p}\\b') THEN '{p}'" for p in phrases)
    return f"CASE{whens} END"


CATEGORY_WORDS_SQL = {
    "Beauty": "beauty",
    "Clothing": "clothing",
    "Electronics": "electronics",
    "Health & Personal Care": "health|personal|care",
    "Sports & Outdoors": "sports|outdoors",
}


def category_sql(x):
    n = norm_sql(x)
    whens = "".join(
        f" WHEN contains({n}, '{c.lower()}') OR regexp_matches({n}, '\\b({w})\\b') THEN '{c}'"
        for c, w in CATEGORY_WORDS_SQL.items()
    )
    return f"CASE{whens} END"


def brand_sql(x):
    n = norm_sql(x)
    brands = sorted("Nova Orbit Luma Stride Haven Pulse Aster Kindlewood".split())
    whens = "".join(f" WHEN regexp_matches({n}, '\\b{b.lower()}\\b') THEN '{b}'" for b in brands)
    return f"CASE{whens} END"


@check("extract_price", f"SELECT id, {price_sql('text')} AS price_constraint FROM rule_texts", "rule_texts")
def extract_price(spark, sf):
    return rule_texts(spark, sf).select("id", rules.extract_price("text").alias("price_constraint"))


@check("extract_use_case", f"SELECT id, {use_case_sql('text')} AS use_case FROM rule_texts", "rule_texts")
def extract_use_case(spark, sf):
    return rule_texts(spark, sf).select("id", rules.extract_use_case("text").alias("use_case"))


@check("extract_category", f"SELECT id, {category_sql('text')} AS category FROM rule_texts", "rule_texts")
def extract_category(spark, sf):
    asked = rule_texts(spark, sf).withColumnRenamed("text", "query_text")
    return phrases.with_known(asked, Inputs(spark, sf).items).select("id", F.col("known_category").alias("category"))


@check("extract_brand", f"SELECT id, {brand_sql('text')} AS brand FROM rule_texts", "rule_texts")
def extract_brand(spark, sf):
    asked = rule_texts(spark, sf).withColumnRenamed("text", "query_text")
    return phrases.with_known(asked, Inputs(spark, sf).items).select("id", F.col("known_brand").alias("brand"))


PARSED = f"""{intent_sql('query_text')} AS intent,
 coalesce({category_sql('query_text')}, category) AS category,
 coalesce({brand_sql('query_text')}, brand) AS brand,
 coalesce({price_sql('query_text')}, price_constraint) AS price_constraint,
 coalesce({use_case_sql('query_text')}, use_case) AS use_case"""


@check("parse_queries", f"SELECT query_id, {PARSED} FROM pairs", "pairs")
def parse_queries(spark, sf):
    x = Inputs(spark, sf)
    out = q.apply_query_understanding(x.pairs, x.items)
    return out.select("query_id", "intent", "category", "brand", "price_constraint", "use_case")


cte(
    "parsed",
    f"""SELECT query_id, query_text, split, target_item_id, intent AS source_intent,
 category AS source_category, brand AS source_brand, price_constraint AS source_price_constraint,
 use_case AS source_use_case, {intent_sql('query_text')} AS p_intent, {category_sql('query_text')} AS p_category,
 {brand_sql('query_text')} AS p_brand, {price_sql('query_text')} AS p_price,
 {use_case_sql('query_text')} AS p_use FROM pairs""",
    "pairs",
)
REWRITE = f"""coalesce(nullif({norm_sql("concat_ws(' ', p_price, p_brand, p_category, p_use)")}, ''),
 {norm_sql('query_text')})"""


@check("rewrite_query", f"SELECT query_id, {REWRITE} AS rewritten_query FROM parsed", "parsed")
def rewrite_query(spark, sf):
    x = Inputs(spark, sf)
    parsed = q.parse_queries(x.pairs, x.items)
    fields = [F.col(c) for c in ("price_constraint", "brand", "category", "use_case")]
    return parsed.select("query_id", rules.rewrite_query("query_text", *fields).alias("rewritten_query"))


def _uniq(*options):
    a = "list_filter([" + ", ".join(norm_sql(o) for o in options) + "], lambda v: v <> '')"
    kept = f"list_filter({a}, lambda v, i: list_position({a}, v) = i)"
    return f"array_to_string(({kept})[1:3], '|')"


@check(
    "expand_query",
    f"SELECT query_id, {_uniq('query_text', REWRITE, chr(39).join(['concat_ws(', ' ', ', p_category, p_use)']))} AS expanded FROM parsed",
    "parsed",
)
def expand_query(spark, sf):
    x = Inputs(spark, sf)
    parsed = q.parse_queries(x.pairs, x.items)
    c = {n: F.col(n) for n in ("price_constraint", "brand", "category", "use_case")}
    rewritten = rules.rewrite_query("query_text", *c.values())
    out = parsed.select(
        "query_id",
        rules.expand_query("query_text", rewritten, c["category"], c["use_case"]).alias("expanded"),
    )
    return out.select("query_id", flat("expanded"))


@check(
    "query_understanding",
    f"""SELECT query_id, source_intent, source_category, source_brand, source_price_constraint,
 source_use_case, p_intent AS parsed_intent, p_category AS parsed_category, p_brand AS parsed_brand,
 p_price AS parsed_price_constraint, p_use AS parsed_use_case, {REWRITE} AS rewritten_query,
 {_uniq('query_text', chr(39).join(['concat_ws(', ' ', ', p_price, p_category, p_use)']),
        chr(39).join(['concat_ws(', ' ', ', p_brand, p_category)']),
        chr(39).join(['concat_ws(', ' ', ', p_use, p_category)']))} AS expanded_queries,
 0.9e0 AS confidence FROM parsed""",
    "parsed",
)
def query_understanding(spark, sf):
    x = Inputs(spark, sf)
    out = q.query_understanding(x.pairs, x.items)
    names = ("intent", "category", "brand", "price_constraint", "use_case")
    return out.select(
        "query_id",
        *[f"source_{n}" for n in names],
        *[f"parsed_{n}" for n in names],
        "rewritten_query",
        flat("expanded_queries"),
        "confidence",
    )


@check(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(b) <= 240 THEN b ELSE rtrim(substr(b, 1, 237)) || '...' END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM documents)""",
)
def truncate_text(spark, sf):
    docs = Inputs(spark, sf).table("documents")
    return docs.select("doc_id", t.truncate_text("text").alias("short"))


@check(
    "token_count",
    """SELECT doc_id, n AS tokens, round(n * 1e-6 + n * 2e-6, 9) AS cost, 0e0 AS mock_cost
FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)""",
)
def token_count(spark, sf):
    docs = Inputs(spark, sf).table("documents")
    n = t.token_count("text")
    return docs.select(
        "doc_id",
        n.alias("tokens"),
        F.round(t.estimated_cost(n, n, F.lit("other")), 9).alias("cost"),
        t.estimated_cost(n, n, F.lit("mock")).alias("mock_cost"),
    )


@check(
    "generate_queries",
    """SELECT query_id, query_text, target_item_id, category, intent, source, brand, price_constraint,
 use_case, relevance_label, split FROM pairs""",
    "pairs",
)
def generate_queries(spark, sf):
    return Inputs(spark, sf).pairs


def _written_queries(spark, sf):
    """Model outputs over all queries: plain, fenced, cut off, a list, or with values of other types."""
    pairs = Inputs(spark, sf).pairs
    category, text = F.col("category"), F.col("query_text")
    constraints = F.struct(F.lit("cheap").alias("price"), F.col("use_case"))
    plain = F.to_json(
        F.struct(
            F.lit("product_search").alias("intent"),
            category,
            F.lit(" Acme ").alias("brand"),
            constraints.alias("constraints"),
            F.lit("a: ").alias("note"),
            F.concat(text, F.lit(" plus")).alias("rewritten_query"),
            F.array(F.upper("query_text"), F.lit("Second  one"), F.lit("third"), F.lit("fourth")).alias(
                "expanded_queries"
            ),
            F.lit(0.8).alias("confidence"),
        )
    )
    odd = F.concat(
        F.lit('{"intent": "unknown", "category": "NULL", "brand": true, "constraints": "none", '),
        F.lit('"price_constraint": 30, "rewritten_query": null, "expanded_queries": "Gift Ideas", '),
        F.lit('"confidence": ["high"], "use_case": null}'),
    )
    output = F.array(
        plain,
        F.concat(F.lit("Sure:\n```json\n"), F.replace(plain, F.lit("0.8"), F.lit('"0.7"')), F.lit("\n``` done")),
        F.substring(plain, 1, 40),
        F.concat(F.lit("["), F.lit("1, 2]")),
        F.concat(F.lit("Answer: "), odd),
    )[F.col("target_item_id") % 5]
    return pairs.withColumn("output_text", output)


cte(
    "written",
    f"""SELECT *, target_item_id % 5 AS kind, kind IN (0, 1) AS good, kind IN (2, 3) AS failed,
 CASE WHEN good THEN 'product_search' WHEN failed THEN p_intent END AS w_intent,
 CASE WHEN good THEN source_category WHEN failed THEN p_category END AS w_category,
 CASE WHEN good THEN 'Acme' WHEN failed THEN p_brand ELSE 'True' END AS w_brand,
 CASE WHEN good THEN 'cheap' WHEN failed THEN p_price ELSE '30' END AS w_price,
 CASE WHEN good THEN source_use_case WHEN failed THEN p_use END AS w_use,
 {norm_sql("concat_ws(' ', w_price, w_brand, w_category, w_use)")} AS w_joined,
 CASE WHEN good THEN query_text || ' plus' ELSE coalesce(nullif(w_joined, ''), {norm_sql('query_text')}) END AS w_rewritten
FROM parsed""",
    "parsed",
)


@check(
    "read_query_understanding",
    f"""SELECT query_id, w_intent AS parsed_intent, w_category AS parsed_category, w_brand AS parsed_brand,
 w_price AS parsed_price_constraint, w_use AS parsed_use_case, w_rewritten AS rewritten_query,
 CASE WHEN good THEN {_uniq('query_text', "'second one'", "'third'")} WHEN kind = 4 THEN {_uniq('query_text', "'gift ideas'")}
  ELSE {_uniq('query_text', 'w_rewritten', chr(39).join(['concat_ws(', ' ', ', w_category, w_use)']))} END AS expanded_queries,
 CASE kind WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.7e0 WHEN 4 THEN NULL ELSE 0e0 END AS confidence,
 NOT failed AS schema_valid, CASE kind WHEN 2 THEN 'output is not JSON' WHEN 3 THEN 'output is not a JSON object' END AS parse_error
FROM written""",
    "written",
)
def read_query_understanding(spark, sf):
    """Fields of plain, fenced, cut off, listed and mistyped outputs over every query."""
    out = q.read_query_understanding(_written_queries(spark, sf), Inputs(spark, sf).items)
    names = ("intent", "category", "brand", "price_constraint", "use_case")
    return out.select(
        "query_id", *[f"parsed_{n}" for n in names], "rewritten_query", flat("expanded_queries"), "confidence",
        "schema_valid", "parse_error",
    )
