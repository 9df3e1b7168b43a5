"""Registry pairing each Spark query with plain SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators import hybrid as h
from aisle.operators import queries as q
from aisle.operators import retrieval as r
from aisle.operators import splits
from aisle.session import deliver_package
from aisle.sources import testdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in CTES[name][0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {head}\n{body}" if ordered else body


def check(name: str, sql: str | None = None, *ctes: str):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, ctes)
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql, *ctes) for name, (sql, ctes) in _SQL.items()}


def flat(column: str, sep: str = "|"):
    """Array column as one text so that both engines hash the same value."""
    return F.concat_ws(sep, F.transform(column, lambda x: x.cast("string"))).alias(column)


class Inputs:
    """The adapted tables of one scale factor.

    Tables that a query reads several times are persisted; Spark rebuilds lost blocks itself.
    """

    _known: dict[tuple[str, str], Inputs] = {}

    def __new__(cls, spark: SparkSession, sf_dir: str) -> Inputs:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            found = super().__new__(cls)
            found.spark, found.dir = spark, sf_dir
            deliver_package(spark)
            cls._known[key] = found
        return cls._known[key]

    @classmethod
    def forget(cls, spark: SparkSession) -> None:
        """Drop everything persisted, so that the next query starts from the files."""
        cls._known.clear()
        spark.catalog.clearCache()

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.dir, name)

    @cached_property
    def items(self) -> DataFrame:
        items = testdata.items(self.spark, self.dir)
        # a file of few bytes is one task, but texts and queries are made from each of its rows
        return items.repartition(skew.layout_parts(items, 0), "item_id").persist()

    @property
    def users(self) -> DataFrame:
        return testdata.users(self.spark, self.dir)

    @property
    def interactions(self) -> DataFrame:
        return testdata.interactions(self.spark, self.dir)

    @cached_property
    def split(self) -> DataFrame:
        return splits.leave_one_out(self.interactions).persist()

    @property
    def train(self) -> DataFrame:
        return self.split.where("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.split.where("split = 'test'")

    @property
    def orders(self) -> DataFrame:
        return testdata.order_interactions(self.spark, self.dir)

    @cached_property
    def pairs(self) -> DataFrame:
        return q.generate_queries(self.items).persist()

    @cached_property
    def bm25(self) -> r.TermIndex:
        return r.bm25_index(self.items).persist()

    @cached_property
    def tfidf(self) -> r.TermIndex:
        return r.tfidf_index(self.items).persist()

    @cached_property
    def fused(self) -> h.FusedIndex:
        return h.fused_index(self.bm25, self.tfidf)


cte(
    "items",
    """
SELECT p_partkey AS item_id, p_name AS title,
  CASE p_type WHEN 'ECONOMY' THEN 'Sports & Outdoors' WHEN 'SMALL' THEN 'Beauty'
    WHEN 'MEDIUM' THEN 'Electronics' WHEN 'PROMO' THEN 'Clothing'
    WHEN 'STANDARD' THEN 'Health & Personal Care' ELSE 'Electronics' END AS category,
  ['Nova','Orbit','Luma','Stride','Haven','Pulse','Aster','Kindlewood']
    [CAST(substr(p_brand, 7) AS INT) % 8 + 1] AS brand,
  round(8 + p_size * 4.24e0, 2) AS price,
  round(3.2e0 + ((p_partkey * 37) % 181) / 1e2, 2) AS avg_rating,
  CAST(coalesce(n, 0) AS BIGINT) AS rating_count,
  lower(p_type) || ' ' || p_name || ' size ' || p_size AS description
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
  ON l_partkey = p_partkey""",
)
cte(
    "users",
    """
SELECT c_custkey AS user_id, c_mktsegment AS user_age_bucket, r_name AS user_region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "inter",
    """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id,
  ts AS "timestamp",
  CASE event_type WHEN 'signup' THEN 'add_to_cart' ELSE event_type END AS event_type,
  CASE event_type WHEN 'view' THEN 2e0 WHEN 'click' THEN 3e0 WHEN 'signup' THEN 4e0 ELSE 5e0 END
    AS rating,
  CASE event_type WHEN 'view' THEN 1e0 WHEN 'click' THEN 2e0 WHEN 'signup' THEN 3e0 ELSE 4e0 END
    AS event_weight
FROM events WHERE event_type <> 'error'""",
)
cte(
    "loo",
    """
SELECT * EXCLUDE (back), CASE WHEN back = 1 THEN 'test' WHEN back = 2 THEN 'val' ELSE 'train' END
  AS split
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC)
  AS back FROM inter)""",
    "inter",
)
cte("train", "SELECT * FROM loo WHERE split = 'train'", "loo")
cte("test", "SELECT * FROM loo WHERE split = 'test'", "loo")
cte(
    "order_inter",
    """
SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS "timestamp",
  'purchase' AS event_type, 5e0 AS rating, 4e0 AS event_weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)

PRICE_RE = "(cheap|budget|affordable|under|low cost|deal|discount)"
USE_RE = "(beginner|gym|running|travel|dry skin|walking|outdoor|office|school|gift)"
CAT_RE = "(sports|outdoors|beauty|electronics|clothing|health|personal care|skincare)"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def intent_sql(x: str) -> str:
    n = norm_sql(x)
    t = f"list_distinct({tokens_sql(n)})"
    return f"""CASE WHEN coalesce({n}, '') = '' THEN 'unknown'
 WHEN regexp_matches({n}, '{PRICE_RE}') THEN 'price_sensitive_search'
 WHEN regexp_matches({n}, '{USE_RE}') THEN 'use_case_search'
 WHEN list_has_any({t}, ['nova','orbit','luma','stride','haven','pulse','aster','kindlewood'])
   THEN 'brand_search'
 WHEN regexp_matches({n}, '{CAT_RE}') AND len({t}) <= 5 THEN 'category_search'
 ELSE 'product_search' END"""


def hashed_sql(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({joined})"


def hashed_int_sql(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr({hashed_sql(*parts)}, 1, 8) AS UBIGINT) AS BIGINT)"


def slug_sql(x: str) -> str:
    flat_text = f"regexp_replace({norm_sql(x)}, '[^a-z0-9]+', '_', 'g')"
    cleaned = f"regexp_replace({flat_text}, '^_+|_+$', '', 'g')"
    return f"coalesce(nullif({cleaned}, ''), 'query')"


cte(
    "query_options",
    f"""
WITH b AS (SELECT *, replace({norm_sql('category')}, '&', 'and') AS label FROM items),
u AS (SELECT *, CASE label WHEN 'sports & outdoors' THEN ['running','outdoor','beginner']
  WHEN 'beauty' THEN ['dry skin','gift','beginner'] WHEN 'electronics' THEN ['travel','office','school']
  WHEN 'clothing' THEN ['walking','office','travel']
  WHEN 'health & personal care' THEN ['gym','travel','gift']
  ELSE ['gift','travel','beginner'] END AS uses,
  CASE WHEN price < 30 THEN 'budget' WHEN price >= 120 THEN 'premium' ELSE 'affordable' END AS pl FROM b),
o AS (
 SELECT item_id, category, brand, {norm_sql('title')} AS query_text, 'title' AS source,
   NULL AS use_case, NULL AS price_constraint FROM u
 UNION ALL SELECT item_id, category, brand, label || ' products', 'category', NULL, NULL FROM u
 UNION ALL SELECT item_id, category, brand, lower(brand) || ' ' || label || ' product',
   'brand_category', NULL, NULL FROM u
 UNION ALL SELECT item_id, category, brand, uc || ' ' || label, 'use_case', uc, NULL
   FROM (SELECT *, unnest(uses) AS uc FROM u)
 UNION ALL SELECT item_id, category, brand, pl || ' ' || label, 'price_category', NULL, pl FROM u
 UNION ALL SELECT item_id, category, brand,
   CASE WHEN avg_rating >= 4.4 THEN 'high rated' ELSE 'popular' END || ' ' || label || ' item',
   'descriptive', NULL, NULL FROM u)
SELECT DISTINCT * FROM o WHERE query_text <> ''""",
    "items",
)
cte(
    "pairs",
    f"""
SELECT query_id, query_text, target_item_id, category, {intent_sql('query_text')} AS intent, source,
  brand, price_constraint, use_case, 1 AS relevance_label,
  CASE WHEN d < 80 THEN 'train' WHEN d < 90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, {hashed_int_sql('42', 'query_id')} % 100 AS d FROM (
  SELECT *, item_id AS target_item_id, 'q_' || item_id || '_' || lpad(CAST(n AS VARCHAR), 2, '0')
    || '_' || {slug_sql('source')} AS query_id
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id
    ORDER BY {hashed_sql('42', 'item_id', 'source', 'query_text')}) AS n FROM query_options)
  WHERE n <= 3))""",
    "query_options",
)
cte("texts", "SELECT DISTINCT query_text FROM pairs", "pairs")
cte(
    "qterms",
    f"""
SELECT query_text, term, count(*) AS qf
FROM (SELECT query_text, unnest({tokens_sql('query_text')}) AS term FROM texts) GROUP BY 1, 2""",
    "texts",
)
cte(
    "item_texts",
    """
SELECT item_id, concat_ws(' ', title, category, brand, description) AS body FROM items""",
    "items",
)


def bm25_ctes(prefix: str, docs: str, terms: str, k1: float = 1.5, b: float = 0.75) -> None:
    """CTEs for BM25 scores of ``terms``(query_text, term, qf) over ``docs``(item_id, term, tf)."""
    cte(
        f"{prefix}_scores",
        f"""
SELECT query_text, item_id, round(sum(idf * qf * tf * ({k1}e0 + 1)
    / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * dl / avgdl))), 9) AS score
FROM {terms} JOIN {docs} USING (term)
JOIN (SELECT term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf
  FROM (SELECT term, count(*) AS df FROM {docs} GROUP BY 1), {prefix}_n) USING (term)
JOIN (SELECT item_id, CAST(sum(tf) AS DOUBLE) AS dl FROM {docs} GROUP BY 1) USING (item_id),
(SELECT sum(tf) / any_value(n) AS avgdl FROM {docs}, {prefix}_n)
GROUP BY 1, 2""",
        docs,
        terms,
        f"{prefix}_n",
    )


cte(
    "item_terms",
    f"""
SELECT item_id, term, CAST(count(*) AS DOUBLE) AS tf
FROM (SELECT item_id, unnest({tokens_sql('body')}) AS term FROM item_texts) GROUP BY 1, 2""",
    "item_texts",
)
cte("bm25_n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM items", "items")
bm25_ctes("bm25", "item_terms", "qterms")
cte(
    "vocab",
    """
SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
FROM (SELECT term, count(*) AS df FROM item_terms GROUP BY 1 ORDER BY df DESC, term LIMIT 5000),
  bm25_n""",
    "item_terms",
    "bm25_n",
)


def weigh_sql(counts: str, key: str, tf: str = "tf") -> str:
    return f"""
SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
  SELECT {key}, term, {tf} / sum({tf}) OVER (PARTITION BY {key}) * idf AS w
  FROM {counts} JOIN vocab USING (term))"""


cte("item_weights", weigh_sql("item_terms", "item_id"), "item_terms", "vocab")
cte("query_weights", weigh_sql("qterms", "query_text", "qf"), "qterms", "vocab")
cte(
    "tfidf_scores",
    """
SELECT query_text, item_id, round(sum(q.w * i.w), 9) AS score
FROM query_weights q JOIN item_weights i USING (term) GROUP BY 1, 2""",
    "item_weights",
    "query_weights",
)
cte(
    "all_scores",
    """
SELECT query_text, item_id, coalesce(b.score, 0) AS bm25_score, coalesce(t.score, 0) AS dense_score
FROM texts CROSS JOIN (SELECT item_id FROM items)
LEFT JOIN bm25_scores b USING (query_text, item_id)
LEFT JOIN tfidf_scores t USING (query_text, item_id)""",
    "texts",
    "items",
    "bm25_scores",
    "tfidf_scores",
)
cte(
    "hybrid_all",
    """
SELECT *, round(0.5e0 * nb + 0.5e0 * nd, 9) AS score FROM (
  SELECT *,
    CASE WHEN max(bm25_score) OVER p > min(bm25_score) OVER p THEN
      (bm25_score - min(bm25_score) OVER p) / (max(bm25_score) OVER p - min(bm25_score) OVER p)
      ELSE 0 END AS nb,
    CASE WHEN max(dense_score) OVER p > min(dense_score) OVER p THEN
      (dense_score - min(dense_score) OVER p) / (max(dense_score) OVER p - min(dense_score) OVER p)
      ELSE 0 END AS nd
  FROM all_scores WINDOW p AS (PARTITION BY query_text))""",
    "all_scores",
)


def top_sql(source: str, score: str, k: int) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY {score} DESC, item_id) AS rank
FROM {source} QUALIFY rank <= {k}"""


cte("bm25_top", top_sql("all_scores", "bm25_score", 50), "all_scores")
cte("tfidf_top", top_sql("all_scores", "dense_score", 50), "all_scores")
cte("hybrid_top", top_sql("hybrid_all", "score", 50), "hybrid_all")
