"""Generation, validation, explanation and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.functions.jsonx import extract_json, is_json_object
from aisle.functions.text import hashed_int
from aisle.operators import explanations as ex
from aisle.operators import generation as g
from aisle.operators import queries as q
from aisle.operators import serving
from aisle.operators.profiles import behavior_summary
from aisle.session import cut_lineage, keep_columns
from checks.base import Inputs, check, cte, flat, hashed_int_sql
from checks.ranking import candidate_frame, rounded

cte(
    "pool20",
    """SELECT query_id, candidate_item_id, CAST(candidate_item_id AS VARCHAR) AS id, hybrid_score, hybrid_rank,
 row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, hybrid_rank, candidate_item_id) AS n
FROM candidates QUALIFY n <= 20""",
    "candidates",
)
cte(
    "ctx",
    """SELECT query_id, any_value(split) AS split, any_value(target_item_id) AS target_item_id,
 list(id ORDER BY n) AS ids FROM pool20 JOIN pairs USING (query_id) GROUP BY 1""",
    "pool20",
    "pairs",
)


def contexts(spark, sf):
    x = Inputs(spark, sf)
    frame = candidate_frame(spark, sf)
    parsed = q.query_understanding(x.pairs, x.items)
    return keep_columns(g.query_contexts(x.pairs, x.items, frame, parsed), "contexts"), frame


@check(
    "format_candidates",
    """SELECT query_id, count(*) AS n, string_agg(id || ':' || hybrid_rank || ':' || title || ':' || category || ':' || brand
  || ':' || rating_count, '|' ORDER BY n) AS listed, round(sum(hybrid_score), 5) AS total_score,
 round(sum(price), 4) AS total_price,
 min(CASE WHEN length(body) <= 240 THEN body ELSE rtrim(substr(body, 1, 237)) || '...' END) AS first_text
FROM (SELECT *, trim(regexp_replace(concat_ws(' ', title, category, brand, description), '\\s+', ' ', 'g')) AS body
  FROM pool20 JOIN items ON item_id = candidate_item_id) GROUP BY 1""",
    "pool20",
    "items",
)
def format_candidates(spark, sf):
    from aisle.operators.ranking import top_candidates

    x = Inputs(spark, sf)
    top = top_candidates(candidate_frame(spark, sf), 20)
    out = g.format_candidates(top, x.items, 20)
    line = F.transform(
        "candidates",
        lambda c: F.concat_ws(":", c["item_id"], c["rank"], c["title"], c["category"], c["brand"], c["rating_count"]),
    )

    def total(field):
        return F.aggregate("candidates", F.lit(0.0), lambda a, c: a + c[field])

    return out.select(
        "query_id",
        F.size("candidates").alias("n"),
        F.concat_ws("|", line).alias("listed"),
        F.round(total("score"), 5).alias("total_score"),
        F.round(total("price"), 4).alias("total_price"),
        F.array_min(F.transform("candidates", lambda c: c["evidence_text"])).alias("first_text"),
    )


@check(
    "query_contexts",
    """SELECT query_id, split, target_item_id, array_to_string(ids, '|') AS ids, p_intent AS intent
FROM ctx JOIN (SELECT query_id, p_intent FROM parsed) USING (query_id)""",
    "ctx",
    "parsed",
)
def query_contexts(spark, sf):
    out, _ = contexts(spark, sf)
    return out.select(
        "query_id", "split", "target_item_id", F.concat_ws("|", g.candidate_ids()).alias("ids"),
        F.get_json_object("parsed_query", "$.intent").alias("intent"),
    )


def _prompt_sql(task, extra):
    return f"""SELECT query_id, 'TASK: {task}' || chr(10) || 'Query: ' || query_text || chr(10) || 'Top K: 10' AS head,
 {extra} AS body_ids FROM ctx JOIN (SELECT query_id, query_text FROM pairs) USING (query_id)"""


@check(
    "build_prompts",
    _prompt_sql("CANDIDATE_CONSTRAINED_GENERATION", "array_to_string(ids, '|')"),
    "ctx",
    "pairs",
)
def build_prompts(spark, sf):
    out, _ = contexts(spark, sf)
    prompt = g.build_prompt("CANDIDATE_CONSTRAINED_GENERATION", 10)
    payload = F.regexp_extract(prompt, r"(?m)^Candidates JSON: (.*)$", 1)
    ids = F.from_json(payload, "candidates array<struct<item_id:string>>")["candidates"]["item_id"]
    return out.select(
        "query_id", F.substring_index(prompt, "\n", 3).alias("head"), F.concat_ws("|", ids).alias("body_ids")
    )


@check(
    "build_query_prompts",
    """SELECT query_id, 'TASK: QUERY_UNDERSTANDING' || chr(10) || 'Query: ' || query_text || chr(10)
 || 'Known categories: ' || (SELECT string_agg(DISTINCT category, ' | ' ORDER BY category) FROM items) || chr(10)
 || 'Known brands: ' || (SELECT string_agg(DISTINCT brand, ' | ' ORDER BY brand) FROM items) || chr(10)
 || 'Max expanded queries: 3' || chr(10) || 'Answer as JSON with intent, category, brand, constraints, '
 || 'rewritten_query, expanded_queries and confidence.' AS prompt FROM pairs""",
    "pairs",
    "items",
)
def build_query_prompts(spark, sf):
    x = Inputs(spark, sf)
    return g.build_query_prompts(x.pairs, x.items).select("query_id", "prompt")


@check(
    "build_profile_prompts",
    """SELECT user_id, history_length, array_to_string(cats, '|') AS top_categories FROM summary""",
    "summary",
)
def build_profile_prompts(spark, sf):
    x = Inputs(spark, sf)
    prompt = g.build_profile_prompt()
    payload = F.regexp_extract(prompt, r"(?m)^Behavior summary: (.*)$", 1)
    back = F.from_json(payload, "history_length long, top_categories array<string>")
    out = behavior_summary(x.train, x.items).select("user_id", back.alias("b"))
    return out.select("user_id", "b.history_length", F.concat_ws("|", "b.top_categories").alias("top_categories"))


def echo_model(prompts):
    """A stand-in for a user's model function: any callable from texts to texts."""
    return [f"echo {p}" for p in prompts]


@check(
    "batch_infer",
    """SELECT conv_id, turn, 'echo ' || text AS output_text, len(regexp_extract_all(text, '\\S+')) AS prompt_tokens,
 round(len(regexp_extract_all(text, '\\S+')) * 3e-6 + 2e-6, 9) AS estimated_cost_usd FROM conversations""",
)
def batch_infer(spark, sf):
    turns = Inputs(spark, sf).table("conversations")
    prompts = turns.select("conv_id", "turn", F.col("text").alias("prompt"))
    out = g.batch_infer(prompts, echo_model, "local", "echo", partitions=8)
    return out.select(
        "conv_id", "turn", "output_text", "prompt_tokens",
        F.round("estimated_cost_usd", 9).alias("estimated_cost_usd"),
    )


KIND_SQL = f"{hashed_int_sql('7', 'query_id')} % 6"


def _messy(spark, sf):
    """Constrained answers of every query in plain, fenced, broken, listed and padded forms."""
    ctx, _ = contexts(spark, sf)
    kind = hashed_int(F.lit(7), "query_id") % 6
    plain = g.constrained_rule(10)
    stray = F.to_json(
        F.struct(
            F.concat(g.candidate_ids(3), F.array(F.lit(" 0 "), F.lit("nowhere"), F.lit(""))).alias(
                "recommended_item_ids"
            ),
            F.array(F.struct(F.lit("extra").alias("item_id"), F.lit("why").alias("reason"))).alias("ranked_items"),
        )
    )
    text = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), plain, F.lit("\n```\nbye {}")))
        .when(kind == 2, "{broken json")
        .when(kind == 3, "[1, 2, 3]")
        .when(kind == 4, stray)
        .otherwise(F.concat(F.lit("Answer "), plain, F.lit(" done")))
    )
    return ctx.withColumn("kind", kind).withColumn("output_text", text)


cte("messy", f"SELECT *, {KIND_SQL} AS kind FROM ctx", "ctx")
cte(
    "messy_parsed",
    """SELECT *, kind NOT IN (2, 3) AS ok, CASE WHEN kind IN (2, 3) THEN []::VARCHAR[]
 WHEN kind = 4 THEN (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (
   SELECT unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT list_concat(ids[1:3], ['0', 'nowhere', 'extra']) AS l))
   GROUP BY x))
 ELSE ids[1:10] END AS out FROM messy""",
    "messy",
)


@check(
    "extract_json",
    """SELECT query_id, kind NOT IN (2, 3) AS is_object FROM messy""",
    "messy",
)
def extract_json_query(spark, sf):
    return _messy(spark, sf).select("query_id", is_json_object(extract_json("output_text")).alias("is_object"))


@check(
    "parse_recommendations",
    """SELECT query_id, ok AS parse_success, array_to_string(out, '|') AS recommended_item_ids, len(out) AS ranked,
 CASE WHEN kind = 4 THEN 1 ELSE 0 END AS reasons_why FROM messy_parsed""",
    "messy_parsed",
)
def parse_recommendations(spark, sf):
    out = g.parse_recommendations(_messy(spark, sf))
    return out.select(
        "query_id", "parse_success", flat("recommended_item_ids"), F.size("ranked_items").alias("ranked"),
        F.size(F.filter("ranked_items", lambda r: r["reason"] == "why")).alias("reasons_why"),
    )


@check(
    "validate_ids",
    """SELECT query_id, array_to_string(list_filter(out, lambda x: list_contains(ids, x)), '|') AS recommended_item_ids,
 array_to_string(list_filter(out, lambda x: NOT list_contains(ids, x)), '|') AS invalid_item_ids,
 ok AND len(list_filter(out, lambda x: NOT list_contains(ids, x))) = 0 AS schema_valid FROM messy_parsed""",
    "messy_parsed",
)
def validate_ids(spark, sf):
    out = g.validate_ids(g.parse_recommendations(_messy(spark, sf)), g.candidate_ids())
    return out.select("query_id", flat("recommended_item_ids"), flat("invalid_item_ids"), "schema_valid")


@check(
    "check_catalog_ids",
    """SELECT query_id, count(*) FILTER (item_id IS NOT NULL) AS valid_item_count,
 count(*) FILTER (x IS NOT NULL AND item_id IS NULL) AS invalid_item_count
FROM (SELECT query_id, unnest(CASE WHEN len(out) = 0 THEN [NULL] ELSE out END) AS x FROM messy_parsed)
LEFT JOIN items ON CAST(item_id AS VARCHAR) = x GROUP BY 1""",
    "messy_parsed",
    "items",
)
def check_catalog_ids(spark, sf):
    parsed = g.parse_recommendations(_messy(spark, sf))
    out = g.check_catalog_ids(parsed, Inputs(spark, sf).items)
    return out.select("query_id", "valid_item_count", "invalid_item_count")


@check(
    "fallback_to_candidates",
    """SELECT query_id, f AS used_fallback, array_to_string(CASE WHEN f THEN ids[1:10] ELSE out END, '|') AS recommended_item_ids
FROM (SELECT *, NOT ok OR len(list_filter(out, lambda x: NOT list_contains(ids, x))) > 0 AS f FROM messy_parsed)""",
    "messy_parsed",
)
def fallback_to_candidates(spark, sf):
    checked = g.validate_ids(g.parse_recommendations(_messy(spark, sf)), g.candidate_ids())
    out = g.fallback_to_candidates(checked)
    return out.select("query_id", "used_fallback", flat("recommended_item_ids"))


DIRECT = "['item_00001','item_mock_invalid_001','item_00002','item_00003','item_00004','item_00005','item_00006','item_00007','item_00008','item_00009']"
OUT_COLUMNS = ("query_id", "method", "recommended_item_ids", "parse_success", "schema_valid", "used_fallback", "candidate_pool_size")
OUT_SQL = """SELECT query_id, '{0}' AS method, array_to_string({1}, '|') AS recommended_item_ids, true AS parse_success,
 true AS schema_valid, false AS used_fallback, {2} AS candidate_pool_size FROM ctx"""
RERANK20 = "list_reverse_sort(ids[1:20])[1:10]"
RERANK10 = "list_reverse_sort(ids[1:10])[1:10]"


def _shown(df):
    return df.select(*[flat(c) if c == "recommended_item_ids" else c for c in OUT_COLUMNS])


@check("direct_generation", OUT_SQL.format("direct_generation", DIRECT, "0"), "ctx")
def direct_generation(spark, sf):
    return _shown(g.direct_generation(contexts(spark, sf)[0]))


@check(
    "constrained_generation",
    OUT_SQL.format("candidate_constrained_generation", "ids[1:10]", "len(ids)"),
    "ctx",
)
def constrained_generation(spark, sf):
    return _shown(g.constrained_generation(contexts(spark, sf)[0]))


@check("rerank_generation", OUT_SQL.format("llm_rerank_top_20", RERANK20, "least(20, len(ids))"), "ctx")
def rerank_generation(spark, sf):
    return _shown(g.rerank_generation(contexts(spark, sf)[0], 20))


EXPERIMENTS = ("direct_generation", "candidate_constrained_generation", "llm_rerank_top_10", "llm_rerank_top_20")
cte(
    "experiments",
    "\nUNION ALL ".join(
        [
            f"SELECT query_id, split, target_item_id, 'direct_generation' AS method, {DIRECT} AS out FROM ctx",
            "SELECT query_id, split, target_item_id, 'candidate_constrained_generation', ids[1:10] FROM ctx",
            f"SELECT query_id, split, target_item_id, 'llm_rerank_top_10', {RERANK10} FROM ctx",
            f"SELECT query_id, split, target_item_id, 'llm_rerank_top_20', {RERANK20} FROM ctx",
        ]
    ),
    "ctx",
)


@check(
    "genrec_experiments",
    "SELECT query_id, method, array_to_string(out, '|') AS recommended_item_ids FROM experiments",
    "experiments",
)
def genrec_experiments(spark, sf):
    out = g.run_experiments(contexts(spark, sf)[0], EXPERIMENTS)
    return out.select("query_id", "method", flat("recommended_item_ids"))


cte(
    "genrec_pq",
    """SELECT query_id, method, split, avg(v) AS valid_item_rate, avg(1 - v) AS hallucination_rate, min(i) AS r FROM (
 SELECT query_id, method, split, CASE WHEN item_id IS NULL THEN 0e0 ELSE 1e0 END AS v,
  CASE WHEN x = CAST(target_item_id AS VARCHAR) THEN place END AS i
 FROM (SELECT *, unnest(out) AS x, unnest(range(1, len(out) + 1)) AS place FROM experiments)
 LEFT JOIN items ON CAST(item_id AS VARCHAR) = x) GROUP BY 1, 2, 3""",
    "experiments",
    "items",
)
GENREC_SUMMARY = """SELECT method, split, count(*) AS num_queries, round(avg(valid_item_rate), 6) AS valid_item_rate,
 round(avg(hallucination_rate), 6) AS hallucination_rate,
 round(avg(CASE WHEN r <= 10 THEN 1e0 ELSE 0 END), 6) AS recall_at_10,
 round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_at_10,
 round(avg(CASE WHEN r <= 10 THEN 1e0 / r ELSE 0 END), 6) AS mrr_at_10 FROM genrec_pq GROUP BY 1, 2"""


@check("genrec_metrics", GENREC_SUMMARY, "genrec_pq")
def genrec_metrics(spark, sf):
    from aisle.operators import metrics as m

    x = Inputs(spark, sf)
    outputs = g.run_experiments(contexts(spark, sf)[0], EXPERIMENTS)
    summary = m.genrec_metrics(m.genrec_per_query(outputs, x.pairs, x.items))
    names = ["method", "split", "num_queries", "valid_item_rate", "hallucination_rate", "recall_at_10", "ndcg_at_10", "mrr_at_10"]
    return rounded(summary.select(*names))


EVIDENCE = """SELECT query_id, place, item_id AS id, title, category, brand, round(price, 2) AS price, round(avg_rating, 2) AS avg_rating,
 rating_count, round(coalesce(hybrid_score, 0), 6) AS retrieval_score,
 title || ' ' || category || ' ' || brand || ' rating ' || format('{:.2f}', avg_rating) || ' price ' || format('{:.2f}', price) AS evidence_text
FROM (SELECT query_id, unnest(ids[1:5]) AS x, unnest(range(len(ids[1:5]))) AS place FROM ctx)
JOIN items ON CAST(item_id AS VARCHAR) = x LEFT JOIN (SELECT query_id, id, hybrid_score FROM pool20) USING (query_id)
WHERE id = x"""
cte("evidence", EVIDENCE, "ctx", "items", "pool20")


def evidence_frame(spark, sf):
    ctx, frame = contexts(spark, sf)
    recs = g.constrained_generation(ctx)
    return ex.select_evidence(recs, Inputs(spark, sf).items, frame), ctx


@check("select_evidence", "SELECT * EXCLUDE (id), CAST(id AS VARCHAR) AS item_id FROM evidence", "evidence")
def select_evidence(spark, sf):
    out, _ = evidence_frame(spark, sf)
    return rounded(out)


TEMPLATE = """title || ' matches because it is a ' || category || ' item from ' || brand || ' with rating '
 || format('{:.2f}', avg_rating) || '.'"""
GROUNDED = """title || ' matches the query using catalog evidence from ' || category || ' and ' || brand || '.'"""


@check(
    "explain",
    f"""SELECT query_id, 'template_explanation' AS method, string_agg({TEMPLATE}, '|' ORDER BY place) AS texts,
 false AS used_fallback FROM evidence GROUP BY 1
UNION ALL SELECT query_id, 'evidence_grounded_llm_explanation', string_agg({GROUNDED}, '|' ORDER BY place), false
FROM evidence GROUP BY 1""",
    "evidence",
)
def explain(spark, sf):
    evidence = cut_lineage(evidence_frame(spark, sf)[0])
    both = ex.template_explanations(evidence).unionByName(
        ex.grounded_explanations(evidence), allowMissingColumns=True
    )
    texts = F.concat_ws("|", F.transform("explanations", lambda x: x["explanation"]))
    return both.select("query_id", "method", texts.alias("texts"), "used_fallback")


@check(
    "faithfulness",
    f"""SELECT a.query_id, count(DISTINCT a.place) FILTER (b.place <> a.place AND
  ((b.category <> a.category AND contains(lower(t), lower(b.category)))
   OR (b.brand <> a.brand AND contains(lower(t), lower(b.brand))))) AS ungrounded_claim_count,
 0 AS missing_evidence_count
FROM (SELECT *, {TEMPLATE.replace("category ||", "first_category ||")} AS t FROM (
  SELECT *, first_value(category) OVER (PARTITION BY query_id ORDER BY place) AS first_category FROM evidence)) a
JOIN evidence b USING (query_id) GROUP BY 1""",
    "evidence",
)
def faithfulness(spark, sf):
    """Template texts that wrongly name the first item's category, so that some are ungrounded."""
    from pyspark.sql import Window

    evidence = cut_lineage(evidence_frame(spark, sf)[0])
    first = F.first("category").over(Window.partitionBy("query_id").orderBy("place"))
    wrong = ex._explanations(evidence.withColumn("category", first), ex.template_text(), 0.75)
    out = ex.faithfulness(wrong, evidence)
    return out.select("query_id", "ungrounded_claim_count", "missing_evidence_count")


cte(
    "requests",
    """SELECT 'k' || query_text AS request_id, upper(query_text) AS query_text, query_text AS stored FROM texts
UNION ALL SELECT 'm' || title || brand, title || ' by ' || brand, NULL FROM (SELECT DISTINCT title, brand FROM items)""",
    "texts",
    "items",
)


def _requests(spark, sf):
    x = Inputs(spark, sf)
    known = x.pairs.select("query_text").distinct().select(
        F.concat(F.lit("k"), "query_text").alias("request_id"), F.upper("query_text").alias("query_text")
    )
    other = x.items.select("title", "brand").distinct().select(
        F.concat(F.lit("m"), "title", "brand").alias("request_id"),
        F.concat("title", F.lit(" by "), "brand").alias("query_text"),
    )
    return known.unionByName(other)


cte(
    "overlap_top",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, avg_rating DESC, item_id) AS rank FROM (
 SELECT request_id, item_id, avg_rating, len(list_intersect(q, t)) / CAST(greatest(len(q), 1) AS DOUBLE) AS score
 FROM (SELECT request_id, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS q FROM requests WHERE stored IS NULL)
 CROSS JOIN (SELECT item_id, avg_rating, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS t
  FROM item_texts JOIN (SELECT item_id, avg_rating FROM items) USING (item_id)))) WHERE rank <= 10""",
    "requests",
    "item_texts",
    "items",
)


@check(
    "text_fallback_search",
    "SELECT request_id AS query_id, item_id, round(score, 6) AS score, rank FROM overlap_top",
    "overlap_top",
)
def text_fallback_search(spark, sf):
    from aisle.operators.retrieval import text_fallback_search as run

    asked = _requests(spark, sf).where("request_id LIKE 'm%'").withColumnRenamed("request_id", "query_id")
    out = run(asked, Inputs(spark, sf).items, 10)
    return rounded(out.select("query_id", "item_id", "score", "rank"))


@check(
    "search",
    """SELECT request_id, item_id, round(hybrid_score, 6) AS score, hybrid_rank AS rank, 'candidates' AS source, brand
FROM (SELECT request_id, p.query_id FROM requests JOIN pairs p ON p.query_text = stored
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY p.split, p.query_id) = 1)
JOIN pool20 USING (query_id) JOIN items ON item_id = candidate_item_id WHERE n <= 10
UNION ALL SELECT request_id, item_id, round(score, 6), rank, 'text_fallback', brand FROM overlap_top JOIN (SELECT item_id, brand FROM items) USING (item_id)""",
    "requests",
    "pairs",
    "pool20",
    "overlap_top",
    "items",
)
def search(spark, sf):
    x = Inputs(spark, sf)
    frame = candidate_frame(spark, sf)
    out = serving.search(_requests(spark, sf), x.pairs, frame, x.items, 10)
    return rounded(out.select("request_id", "item_id", "score", "rank", "source", "brand"))


@check(
    "genrec_lookup",
    """SELECT query_id, split <> 'train' AS from_store, array_to_string(CASE WHEN split = 'train' THEN ids[1:10] ELSE
  list_reverse_sort(ids[1:10])[1:10] END, '|') AS recommended_item_ids, 1e0 AS valid_item_rate FROM ctx""",
    "ctx",
)
def genrec_lookup(spark, sf):
    ctx, _ = contexts(spark, sf)
    name = "llm_rerank_top_10"
    stored = cut_lineage(g.rerank_generation(ctx.where("split <> 'train'"), 10))
    out = serving.genrec_lookup(ctx, stored, Inputs(spark, sf).items, name)
    return out.select("query_id", "from_store", flat("recommended_item_ids"), "valid_item_rate")
