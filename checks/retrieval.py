"""Index, retrieval and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import hybrid as h
from aisle.operators import retrieval as r
from aisle.sources import testdata
from checks.base import Inputs, bm25_ctes, check, cte, tokens_sql


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@check(
    "bm25_index",
    """SELECT item_id, term, tf, dl, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf,
 round(tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 6) AS weight
FROM item_terms
JOIN (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf
  FROM item_terms, bm25_n GROUP BY 1) USING (term)
JOIN (SELECT item_id, sum(tf) AS dl FROM item_terms GROUP BY 1) USING (item_id),
(SELECT sum(tf) / any_value(n) AS avgdl FROM item_terms, bm25_n)""",
    "item_terms",
    "bm25_n",
)
def bm25_index(spark, sf):
    index = Inputs(spark, sf).bm25
    joined = index.postings.join(index.terms, "term")
    return _rounded(joined.select("item_id", "term", "tf", "dl", "df", "idf", "weight"), "idf", "weight")


TOPK = """SELECT query_id, item_id, round({0}, 6) AS score, rank
FROM pairs JOIN {1} USING (query_text)"""


@check("bm25_topk", TOPK.format("bm25_score", "bm25_top"), "pairs", "bm25_top")
def bm25_topk(spark, sf):
    x = Inputs(spark, sf)
    top = r.bm25_topk(x.bm25, x.pairs, 50)
    return _rounded(top.select("query_id", "item_id", "score", "rank"), "score")


WEIGHTED = """
SELECT item_id, term, sum(w) AS tf FROM (
 SELECT item_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term, 1e0 AS w FROM items
 UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(category), '[a-z0-9]+')), 2e0 FROM items
 UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(brand), '[a-z0-9]+')), 1e0 FROM items
 UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')), 1e0 FROM items)
GROUP BY 1, 2"""
cte("weighted_terms", WEIGHTED, "items")
cte("weighted_n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM items", "items")
bm25_ctes("weighted", "weighted_terms", "qterms", 1.5, 0.25)


@check(
    "bm25_field_weights",
    """SELECT query_text, item_id, round(score, 6) AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank
 FROM weighted_scores) WHERE rank <= 50""",
    "weighted_scores",
)
def bm25_field_weights(spark, sf):
    x = Inputs(spark, sf)
    weights = {"title": 1.0, "category": 2.0, "brand": 1.0, "description": 1.0}
    index = r.bm25_index(x.items, b=0.25, field_weights=weights)
    top = r.topk_texts(index, r.distinct_texts(x.pairs), 50, fill=False)
    return _rounded(top.select("query_text", "item_id", "score", "rank"), "score")


cte(
    "doc_terms",
    f"""SELECT item_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (
 SELECT doc_id AS item_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY 1, 2""",
)
cte(
    "bench_terms",
    f"""SELECT query_text, term, count(*) AS qf FROM (
 SELECT text AS query_text, unnest({tokens_sql('text')}) AS term
 FROM (SELECT DISTINCT text FROM benchmark)) GROUP BY 1, 2""",
)
cte("doc_n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM documents")
bm25_ctes("doc", "doc_terms", "bench_terms")


@check(
    "bm25_documents",
    """SELECT item_id AS query_id, doc AS item_id, round(score, 6) AS score, rank
FROM benchmark JOIN (
 SELECT query_text, item_id AS doc, score,
  row_number() OVER (PARTITION BY query_text ORDER BY score DESC, item_id) AS rank FROM doc_scores)
 ON query_text = text WHERE rank <= 50""",
    "doc_scores",
)
def bm25_documents(spark, sf):
    index = r.bm25_index(testdata.documents_as_items(spark, sf), fields=["description"])
    top = r.topk(index, testdata.benchmark_queries(spark, sf), 50, fill=False)
    return _rounded(top.select("query_id", "item_id", "score", "rank"), "score")


@check(
    "tfidf_index",
    "SELECT item_id, term, round(w, 6) AS weight FROM item_weights",
    "item_weights",
)
def tfidf_index(spark, sf):
    return _rounded(Inputs(spark, sf).tfidf.postings, "weight")


@check(
    "tfidf_encode_queries",
    "SELECT query_text, term, round(w, 6) AS weight FROM query_weights",
    "query_weights",
)
def tfidf_encode_queries(spark, sf):
    x = Inputs(spark, sf)
    return _rounded(r.encode_queries(x.tfidf, r.distinct_texts(x.pairs)), "weight")


@check("tfidf_topk", TOPK.format("dense_score", "tfidf_top"), "pairs", "tfidf_top")
def tfidf_topk(spark, sf):
    x = Inputs(spark, sf)
    top = r.tfidf_topk(x.tfidf, x.pairs, 50)
    return _rounded(top.select("query_id", "item_id", "score", "rank"), "score")


@check(
    "minmax_normalize",
    """SELECT query_text, item_id, round(bm25_score, 6) AS score, round(nb, 6) AS normalized
FROM hybrid_all SEMI JOIN bm25_scores USING (query_text, item_id)""",
    "hybrid_all",
    "bm25_scores",
)
def minmax_normalize(spark, sf):
    x = Inputs(spark, sf)
    scores = r.matched_scores(x.bm25, r.distinct_texts(x.pairs))
    total = x.items.agg(F.count("*")).scalar()
    return _rounded(r.minmax_normalize(scores, "score", total, "normalized"), "score", "normalized")


@check(
    "hybrid_topk",
    """SELECT query_id, item_id, round(score, 6) AS score, round(bm25_score, 6) AS bm25_score,
 round(dense_score, 6) AS dense_score, rank FROM pairs JOIN hybrid_top USING (query_text)""",
    "pairs",
    "hybrid_top",
)
def hybrid_topk(spark, sf):
    x = Inputs(spark, sf)
    top = h.hybrid_topk(x.fused, x.pairs, 50)
    columns = ["query_id", "item_id", "score", "bm25_score", "dense_score", "rank"]
    return _rounded(top.select(*columns), "score", "bm25_score", "dense_score")


def _overlap_sql(field: str) -> str:
    q = "list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+'))"
    f = f"list_distinct(regexp_extract_all(lower({field}), '[a-z0-9]+'))"
    return f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {f})) / CAST(len({q}) AS DOUBLE) ELSE 0 END"


cte(
    "pool100",
    """
SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY bm25_score DESC, item_id) AS rank
FROM all_scores QUALIFY rank <= 100""",
    "all_scores",
)


@check(
    "overlap_rerank",
    f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM pairs JOIN (
 SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, bm25_score DESC, item_id) AS rank
 FROM (SELECT query_text, item_id, bm25_score, round(0.70e0 * CASE WHEN hi > lo THEN (bm25_score - lo) / (hi - lo) ELSE 0 END
   + 0.35e0 * {_overlap_sql('title')} + 0.25e0 * {_overlap_sql('category')}
   + 0.20e0 * {_overlap_sql('brand')} + 0.05e0 * {_overlap_sql('description')}
   + 0.05e0 * avg_rating / 5 + 0.05e0 * ln(1 + rating_count) / mx, 9) AS score
  FROM (SELECT *, max(bm25_score) OVER (PARTITION BY query_text) AS hi,
     min(bm25_score) OVER (PARTITION BY query_text) AS lo FROM pool100)
  JOIN items USING (item_id), (SELECT greatest(1, max(ln(1 + rating_count))) AS mx FROM items))
 ) USING (query_text) WHERE rank <= 50""",
    "pairs",
    "pool100",
    "items",
)
def overlap_rerank(spark, sf):
    x = Inputs(spark, sf)
    weights = {
        "bm25": 0.70,
        "title_overlap": 0.35,
        "category_overlap": 0.25,
        "brand_overlap": 0.20,
        "description_overlap": 0.05,
        "rating": 0.05,
        "popularity": 0.05,
    }
    top = r.overlap_rerank(x.bm25, x.items, x.pairs, 50, 100, weights)
    return _rounded(top.select("query_id", "item_id", "score", "rank"), "score")
