"""Metric, sequence, sweep and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import metrics as m
from aisle.operators import queries as q

from aisle.operators import recommend as rec
from aisle.operators import reports as rp
from aisle.operators import representation as rep
from aisle.operators import hybrid as h
from aisle.operators import retrieval as r
from aisle.operators import sequence as seq
from aisle.operators import tuning
from aisle.operators.profiles import behavior_summary, profile_vectors, user_profile
from aisle.session import cut_lineage, scratch_dir
from checks.base import Inputs, check, cte, hashed_int_sql
from checks.data import SEQ_ORDER
from checks.ranking import candidate_frame, rounded
from checks.recommend import unseen_top
from checks.vectors import fused_topk_frame


def _target_metrics(k_values, names=("recall", "mrr"), rank="rank"):
    forms = {"recall": "1e0", "mrr": f"1e0 / {rank}", "ndcg": f"1 / log2({rank} + 1)"}
    return ", ".join(
        f"round(avg(CASE WHEN {rank} <= {n} THEN {forms[name]} ELSE 0 END), 6) AS {name}_at_{n}"
        for name in names
        for n in k_values
    )


def _retrieval_sql(top):
    return f"""SELECT split, count(*) AS num_queries, 1e0 AS query_coverage, {_target_metrics((10, 20, 50))}
FROM pairs p LEFT JOIN {top} t ON t.query_text = p.query_text AND t.item_id = p.target_item_id GROUP BY 1"""


@check("retrieval_metrics", _retrieval_sql("bm25_top"), "pairs", "bm25_top")
def retrieval_metrics(spark, sf):
    x = Inputs(spark, sf)
    results = r.topk(x.bm25, x.pairs, 50)
    return rounded(m.retrieval_metrics(m.retrieval_per_query(results, x.pairs)))


@check("retrieval_metrics_hybrid", _retrieval_sql("hybrid_top"), "pairs", "hybrid_top")
def retrieval_metrics_hybrid(spark, sf):
    x = Inputs(spark, sf)
    results = h.hybrid_topk(x.fused, x.pairs, 50)
    return rounded(m.retrieval_metrics(m.retrieval_per_query(results, x.pairs)))


def _reco_sql(recs):
    return f"""SELECT count(*) AS num_users, round(avg(h), 6) AS hit_rate_at_10, round(avg(h / nt), 6) AS recall_at_10,
 round(avg(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= nt)), 6) AS ndcg_at_10,
 round(avg(coalesce(1e0 / first, 0)), 6) AS mrr_at_10,
 round((SELECT count(DISTINCT item_id) FROM ({recs}) WHERE user_id IN (SELECT user_id FROM test))
   / (SELECT count(*) FROM items), 6) AS coverage_at_10
FROM (SELECT t.user_id, count(DISTINCT t.item_id) AS nt, count(DISTINCT q.item_id) AS h,
  sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first
 FROM (SELECT DISTINCT user_id, item_id FROM test) t LEFT JOIN ({recs}) q USING (user_id, item_id) GROUP BY 1)"""


ITEMCF = unseen_top("itemcf_scores", "active")


@check("reco_metrics", _reco_sql(ITEMCF), "itemcf_scores", "active", "popular", "train", "test", "items")
def reco_metrics(spark, sf):
    x = Inputs(spark, sf)
    users = x.test.select("user_id").distinct()
    recs = cut_lineage(rec.itemcf_recs(x.train, x.items, users, 10))
    return rounded(m.reco_metrics(recs, x.test, x.items, (10,)))


@check("build_recommender", _reco_sql(
    """SELECT user_id, item_id, pop AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pop DESC, item_id) AS rank
 FROM active CROSS JOIN popular ANTI JOIN train USING (user_id, item_id)) WHERE rank <= 10"""),
    "active", "popular", "train", "test", "items")
def build_recommender(spark, sf):
    x = Inputs(spark, sf)
    recommend = rec.build_recommender("popularity", x.train, x.items)
    recs = cut_lineage(recommend(x.test.select("user_id").distinct(), 10))
    return rounded(m.reco_metrics(recs, x.test, x.items, (10,)))


@check("build_retriever", """SELECT query_id, item_id, rank FROM pairs JOIN tfidf_top USING (query_text)""",
       "pairs", "tfidf_top")
def build_retriever(spark, sf):
    from aisle.plans.retrievers import build_retriever as build

    x = Inputs(spark, sf)
    return build("dense", x.items)(x.pairs, 50).select("query_id", "item_id", "rank")


@check("save_index", """SELECT query_id, item_id, round(bm25_score, 6) AS score, rank FROM pairs JOIN bm25_top USING (query_text)""",
       "pairs", "bm25_top")
def save_index(spark, sf):
    from aisle.sources import files

    x = Inputs(spark, sf)
    path = files.save_index(x.bm25, scratch_dir(spark, "index"), {"method": "bm25", "k1": 1.5, "b": 0.75})
    top = r.topk(files.load_index(spark, path), x.pairs, 50)
    return rounded(top.select("query_id", "item_id", "score", "rank"))


cte(
    "ranked_candidates",
    """SELECT split, query_id, candidate_item_id, label, hybrid_score,
 row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, candidate_item_id) AS r FROM candidates""",
    "candidates",
)


@check(
    "ranking_metrics",
    f"""SELECT split, count(*) AS num_queries, round(avg(covered), 6) AS candidate_coverage,
 {_target_metrics((10, 20), ("ndcg", "mrr"), "r")},
 round(avg(CASE WHEN r <= 10 THEN 0.1e0 ELSE 0 END), 6) AS precision_at_10,
 round(avg(CASE WHEN r <= 20 THEN 0.05e0 ELSE 0 END), 6) AS precision_at_20,
 {_target_metrics((10, 20), ("recall",), "r")}
FROM (SELECT split, query_id, max(label)::DOUBLE AS covered, min(CASE WHEN label = 1 THEN r END) AS r FROM ranked_candidates GROUP BY 1, 2)
GROUP BY 1""",
    "ranked_candidates",
)
def ranking_metrics(spark, sf):
    return rounded(m.ranking_metrics(candidate_frame(spark, sf), ["split"], score="hybrid_score"))


@check(
    "auc",
    """SELECT split, round((sum(CASE WHEN label = 1 THEN mean_rank END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM (
 SELECT split, label, rank() OVER w + (count(*) OVER (PARTITION BY split, hybrid_score) - 1) / 2e0 AS mean_rank,
  sum(label) OVER (PARTITION BY split) AS p, count(*) OVER (PARTITION BY split) AS n FROM candidates
 WINDOW w AS (PARTITION BY split ORDER BY hybrid_score)) GROUP BY split, p, n""",
    "candidates",
)
def auc(spark, sf):
    return rounded(m.auc(candidate_frame(spark, sf), ["split"], "hybrid_score"))


@check(
    "representation_metrics",
    f"""SELECT count(*) AS num_queries, {_target_metrics((10,), ("recall", "ndcg", "mrr"))},
 round(avg(CASE WHEN target_item_id IN (SELECT item_id FROM cold) THEN CASE WHEN rank <= 10 THEN 1e0 ELSE 0 END END), 6) AS cold_start_recall_at_10,
 round((SELECT count(DISTINCT item_id) FROM fused_top WHERE rank <= 10) / (SELECT count(*) FROM items), 6) AS catalog_coverage_at_10,
 round((SELECT count(DISTINCT item_id) FROM fused_top SEMI JOIN cold USING (item_id) WHERE rank <= 10) / (SELECT count(*) FROM cold), 6) AS long_tail_coverage_at_10,
 round((SELECT avg(d / 5e0) FROM (SELECT query_id, count(DISTINCT i.category) AS d FROM pairs JOIN fused_top f USING (query_text)
   JOIN items i ON i.item_id = f.item_id WHERE rank <= 10 GROUP BY 1)), 6) AS category_diversity_at_10
FROM pairs p LEFT JOIN fused_top t ON t.query_text = p.query_text AND t.item_id = p.target_item_id""",
    "pairs",
    "fused_top",
    "cold",
    "items",
)
def representation_metrics(spark, sf):
    x = Inputs(spark, sf)
    results = fused_topk_frame(spark, sf)
    cold = rep.cold_start_items(x.items, x.train)
    return rounded(m.representation_metrics(results, x.pairs, x.items, cold, cold, (10,)))


def _match(p, s):
    return f"""CASE WHEN {s} IS NULL THEN CASE WHEN {p} IS NULL THEN 1e0 ELSE 0 END WHEN {p} IS NULL THEN 0
 WHEN lower({p}) = lower({s}) THEN 1 ELSE 0 END"""


QU = ", ".join(
    f"round(avg({_match(p, 'source_' + s)}), 6) AS {s}_match_rate"
    for p, s in (("p_intent", "intent"), ("p_category", "category"), ("p_brand", "brand"),
                 ("p_price", "price_constraint"), ("p_use", "use_case"))
)


@check(
    "query_understanding_metrics",
    f"""SELECT split, count(*) AS num_queries, 1e0 AS output_parse_success_rate, 1e0 AS schema_valid_rate, {QU}
FROM parsed GROUP BY 1""",
    "parsed",
)
def query_understanding_metrics(spark, sf):
    x = Inputs(spark, sf)
    out = m.query_understanding_metrics(q.query_understanding(x.pairs, x.items))
    return rounded(out.drop("avg_expanded_queries", "estimated_cost_per_1000_queries"))


@check(
    "profile_metrics",
    """SELECT count(*) AS num_users, 1e0 AS profile_generation_success_rate, 1e0 AS schema_valid_rate,
 1e0 AS profile_nonempty_rate, 1e0 AS embedding_coverage,
 round(avg(len(regexp_extract_all(profile_text, '\\S+'))), 6) AS avg_profile_length,
 0e0 AS estimated_cost_per_1000_users FROM profiles""",
    "profiles",
)
def profile_metrics(spark, sf):
    x = Inputs(spark, sf)
    profiles = user_profile(behavior_summary(x.train, x.items))
    return rounded(m.profile_metrics(profiles, profile_vectors(profiles)))


# Sequences.

cte(
    "steps",
    f"""SELECT user_id, position, lag(item_id) OVER (PARTITION BY user_id ORDER BY position) AS prev, item_id AS next FROM (
 SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id {SEQ_ORDER}) AS position FROM train)""",
    "train",
)
cte(
    "trans",
    """SELECT prev, next, n / sum(n) OVER (PARTITION BY prev) AS p FROM (
 SELECT prev, next, CAST(count(*) AS DOUBLE) AS n FROM steps WHERE prev IS NOT NULL GROUP BY 1, 2)""",
    "steps",
)
cte(
    "markov_scores",
    f"""SELECT user_id, next AS item_id, round(sum(w * p), 9) AS score FROM (
 SELECT user_id, item_id AS prev, sum(pow(0.8e0, d)) AS w FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, item_id DESC, event_id DESC) - 1 AS d
  FROM train QUALIFY d < 20) GROUP BY 1, 2) JOIN trans USING (prev) GROUP BY 1, 2""",
    "train",
    "trans",
)
MARKOV = unseen_top("markov_scores", "active")


@check("seq_transitions", "SELECT prev, next, round(p, 6) AS probability FROM trans", "trans")
def seq_transitions(spark, sf):
    return rounded(seq.transitions(Inputs(spark, sf).train))


@check("seq_markov_recs", MARKOV, "markov_scores", "active", "popular", "train")
def seq_markov_recs(spark, sf):
    x = Inputs(spark, sf)
    return rounded(seq.seq_markov_recs(x.train, x.items, x.users, 10))


@check("eval_sequence", _reco_sql(MARKOV), "markov_scores", "active", "popular", "train", "test", "items")
def eval_sequence(spark, sf):
    x = Inputs(spark, sf)
    users = x.test.select("user_id").distinct()
    recs = seq.seq_markov_recs(x.train, x.items, users, 10)
    return rounded(seq.eval_sequence(recs, x.train, x.test, x.items, (10,)))


@check("seq_item2vec_recs")
def seq_item2vec_recs(spark, sf):
    x = Inputs(spark, sf)
    model = seq.train_item2vec(x.train)
    return seq.seq_item2vec_recs(model, x.train, x.items, x.users, 10)


@check(
    "train_sequence",
    """SELECT count(DISTINCT item_id) AS num_items, 32 AS vector_size, count(*) AS num_train_rows FROM train""",
    "train",
)
def train_sequence(spark, sf):
    return seq.train_sequence(Inputs(spark, sf).train, scratch_dir(spark, "item2vec"))


cte(
    "loss_negatives",
    f"""SELECT prev, user_id, position, CASE WHEN v >= t AND n > 1 THEN v + 1 ELSE v END AS idx FROM (
 SELECT *, {hashed_int_sql('42', 'user_id', 'position', 'draw')} % greatest(n - 1, 1) + 1 AS v FROM (
  SELECT user_id, position, prev, item_idx AS t, unnest(range(1, 21)) AS draw FROM steps JOIN catalog ON item_id = next WHERE prev IS NOT NULL),
 (SELECT count(*) AS n FROM items))""",
    "steps",
    "catalog",
    "items",
)
SOFTPLUS = "ln(1 + exp({0}))"


@check(
    "seq_sampled_loss",
    f"""SELECT round(a, 6) AS positive_loss, round(b, 6) AS negative_loss, round(a + b, 6) AS loss FROM
 (SELECT avg({SOFTPLUS.format('-p')}) AS a FROM steps JOIN trans USING (prev, next)),
 (SELECT avg({SOFTPLUS.format('coalesce(p, 0)')}) AS b FROM loss_negatives JOIN catalog ON item_idx = idx
  LEFT JOIN trans ON trans.prev = loss_negatives.prev AND trans.next = item_id)""",
    "steps",
    "trans",
    "loss_negatives",
    "catalog",
)
def seq_sampled_loss(spark, sf):
    x = Inputs(spark, sf)
    return rounded(seq.markov_loss(x.train, x.items))


# Sweeps and comparisons.

CONFIGS = (
    {"name": "a_default"},
    {"name": "b_no_description", "fields": ("title", "category", "brand"), "b": 0.0},
    {"name": "c_category2", "b": 0.25, "field_weights": {"category": 2.0}},
    {"name": "d_title2", "b": 0.0, "field_weights": {"title": 2.0, "category": 2.0, "description": 0.25}},
)


def _sweep_cte(config):
    weights = {f: (config.get("field_weights", {}).get(f, 1.0) if f in config.get("fields", ("title", "category", "brand", "description")) else 0)
               for f in ("title", "category", "brand", "description")}
    b = config.get("b", 0.75)
    parts = "\nUNION ALL ".join(
        f"SELECT item_id, unnest(regexp_extract_all(lower({f}), '[a-z0-9]+')) AS term, {w}e0 AS w FROM items"
        for f, w in weights.items() if w > 0
    )
    name = config["name"]
    cte(f"{name}_terms", f"SELECT item_id, term, sum(w) AS tf FROM ({parts}) GROUP BY 1, 2", "items")
    from checks.base import bm25_ctes

    cte(f"{name}_n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM items", "items")
    bm25_ctes(name, f"{name}_terms", "qterms", 1.5, b)
    return f"""SELECT '{name}' AS config_name, query_text, item_id, coalesce(score, 0) AS score,
 row_number() OVER (PARTITION BY query_text ORDER BY coalesce(score, 0) DESC, item_id) AS rank
 FROM texts CROSS JOIN (SELECT item_id FROM items) LEFT JOIN {name}_scores USING (query_text, item_id) QUALIFY rank <= 50"""


cte("sweep", "\nUNION ALL ".join(f"({_sweep_cte(c)})" for c in CONFIGS), "texts", "items",
    *[f"{c['name']}_scores" for c in CONFIGS])
cte(
    "sweep_pq",
    """SELECT config_name, query_id, p.query_text, source AS query_type, target_item_id, coalesce(rank, 0) AS target_rank
FROM (SELECT * FROM pairs CROSS JOIN (SELECT DISTINCT config_name FROM sweep)) p
LEFT JOIN sweep s USING (config_name, query_text) WHERE s.item_id IS NULL OR s.item_id = target_item_id""".replace(
        "LEFT JOIN sweep s USING (config_name, query_text) WHERE s.item_id IS NULL OR s.item_id = target_item_id",
        "LEFT JOIN sweep s ON s.config_name = p.config_name AND s.query_text = p.query_text AND s.item_id = p.target_item_id",
    ).replace("SELECT config_name, query_id", "SELECT p.config_name, query_id"),
    "pairs",
    "sweep",
)
SWEEP_K = (3, 5, 10, 50)
SUMMARY = f"""SELECT config_name, count(*) AS num_queries,
 {_target_metrics(SWEEP_K, ("recall", "mrr"), "nullif(target_rank, 0)")} FROM sweep_pq GROUP BY 1"""
cte("sweep_summary", SUMMARY.replace("round(avg", "(avg").replace(", 6)", ")"), "sweep_pq")


def sweep(spark, sf):
    x = Inputs(spark, sf)
    configs = tuning.config_table(spark, CONFIGS)
    return cut_lineage(tuning.sweep_topk(x.items, x.pairs, configs, 50)), x.pairs


@check("tuning_sweep", SUMMARY, "sweep_pq")
def tuning_sweep(spark, sf):
    results, pairs = sweep(spark, sf)
    return rounded(tuning.sweep_summary(tuning.sweep_per_query(results, pairs, SWEEP_K)))


cte(
    "multi_text",
    """SELECT config_name, query_text, nr AS num_relevant_items, h10, h50, f10, f50 FROM (
 SELECT config_name, query_text, count(*) FILTER (rank <= 10 AND rel) AS h10, count(*) FILTER (rel) AS h50,
  min(rank) FILTER (rank <= 10 AND rel) AS f10, min(rank) FILTER (rel) AS f50
 FROM (SELECT s.*, r.query_text IS NOT NULL AS rel FROM sweep s LEFT JOIN (SELECT DISTINCT query_text, target_item_id FROM pairs) r
   ON r.query_text = s.query_text AND r.target_item_id = s.item_id) GROUP BY 1, 2)
JOIN (SELECT query_text, count(DISTINCT target_item_id) AS nr FROM pairs GROUP BY 1) USING (query_text)""",
    "sweep",
    "pairs",
)
MULTI = """SELECT config_name, count(*) AS num_unique_query_texts, {r}(avg(num_relevant_items){e} AS avg_relevant_items_per_query_text,
 max(num_relevant_items) AS max_relevant_items_per_query_text,
 {r}(avg((h10 > 0)::INT){e} AS hit_any_at_10, {r}(avg((h50 > 0)::INT){e} AS hit_any_at_50,
 {r}(avg(h10 / num_relevant_items){e} AS recall_multi_at_10, {r}(avg(h50 / num_relevant_items){e} AS recall_multi_at_50,
 {r}(avg(coalesce(1e0 / f10, 0)){e} AS mrr_any_at_10, {r}(avg(coalesce(1e0 / f50, 0)){e} AS mrr_any_at_50 FROM multi_text GROUP BY 1"""


@check("multi_relevant_metrics", MULTI.format(r="round", e=", 6)"), "multi_text")
def multi_relevant_metrics(spark, sf):
    results, pairs = sweep(spark, sf)
    return rounded(m.multi_relevant_summary(m.multi_relevant_metrics(results, pairs, (10, 50))))


cte("multi_summary", MULTI.format(r="", e=")"), "multi_text")


@check(
    "query_type_breakdown",
    f"""SELECT config_name, query_type, count(*) AS num_queries, round(avg(nullif(target_rank, 0)), 6) AS avg_target_rank,
 round(1 - avg((target_rank BETWEEN 1 AND 10)::INT), 6) AS miss_rate_at_10,
 {_target_metrics(SWEEP_K, ("recall", "mrr"), "nullif(target_rank, 0)")} FROM sweep_pq GROUP BY 1, 2""",
    "sweep_pq",
)
def query_type_breakdown(spark, sf):
    results, pairs = sweep(spark, sf)
    return rounded(m.query_type_breakdown(tuning.sweep_per_query(results, pairs, SWEEP_K)))


@check(
    "compare_configs",
    "SELECT b.config_name AS benchmark_config, c.config_name AS candidate_config, c.num_queries, "
    + ", ".join(
        f"round(b.{x}, 6) AS benchmark_{x}, round(c.{x}, 6) AS candidate_{x}, round(c.{x} - b.{x}, 6) + 0 AS delta_{x}"
        for x in rp.STRICT_METRICS
    )
    + " FROM sweep_summary b JOIN sweep_summary c ON b.config_name = 'a_default' AND c.config_name <> 'a_default'",
    "sweep_summary",
)
def compare_configs(spark, sf):
    results, pairs = sweep(spark, sf)
    summary = tuning.sweep_summary(tuning.sweep_per_query(results, pairs, SWEEP_K))
    out = rounded(rp.compare_configs(summary, "a_default", rp.STRICT_METRICS))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in out.columns if c.startswith("delta_")})


ERRORS = """SELECT kind, query_id, query_text, query_type, target_item_id, b AS benchmark_rank, c AS candidate_rank, d AS rank_delta FROM (
 SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, query_id) AS n FROM (
  SELECT 'wins' AS kind, *, c AS o FROM j WHERE (b = 0 OR b > 10) AND c BETWEEN 1 AND 10
  UNION ALL SELECT 'losses', *, b FROM j WHERE b BETWEEN 1 AND 10 AND (c = 0 OR c > 10)
  UNION ALL SELECT 'rank_gains', *, -d FROM j WHERE c > 0
  UNION ALL SELECT 'rank_drops', *, d FROM j WHERE b > 0)) WHERE n <= 5"""
cte(
    "j",
    """SELECT c.query_id, c.query_text, c.query_type, c.target_item_id, b.target_rank AS b, c.target_rank AS c,
 CASE WHEN b.target_rank > 0 THEN b.target_rank ELSE 999 END - CASE WHEN c.target_rank > 0 THEN c.target_rank ELSE 999 END AS d
FROM sweep_pq c JOIN sweep_pq b ON b.query_id = c.query_id AND b.config_name = 'a_default' AND c.config_name = 'd_title2'""",
    "sweep_pq",
)


@check("error_examples", ERRORS, "j")
def error_examples(spark, sf):
    results, pairs = sweep(spark, sf)
    per_query = tuning.sweep_per_query(results, pairs, SWEEP_K)
    return rp.error_examples(per_query, "a_default", "d_title2", 5)


@check(
    "pool_gate",
    """SELECT config_name, round(recall_at_50, 6) AS recall_at_50, round(recall_at_10, 6) AS recall_at_10,
 round(hit_any_at_50, 6) AS hit_any_at_50, round(recall_multi_at_50, 6) AS recall_multi_at_50, pass_mode,
 row_number() OVER (ORDER BY CASE WHEN pass_mode <> '' THEN 0 ELSE 1 END, round(recall_at_50, 9) DESC, round(recall_multi_at_50, 9) DESC,
  round(hit_any_at_50, 9) DESC, round(recall_at_10, 9) DESC, config_name) = 1 AS selected
FROM (SELECT *, CASE WHEN recall_at_50 >= r50 THEN 'single' WHEN hit_any_at_50 >= ha AND recall_multi_at_50 >= rm THEN 'multi' ELSE '' END AS pass_mode
 FROM sweep_summary JOIN multi_summary USING (config_name),
 (SELECT CASE WHEN n <= 100 THEN 0.9 WHEN n <= 1000 THEN 0.6 WHEN n <= 5000 THEN 0.5 WHEN n <= 10000 THEN 0.35 ELSE 0.25 END AS r50,
  CASE WHEN n <= 1000 THEN 0.9 WHEN n <= 5000 THEN 0.85 WHEN n <= 10000 THEN 0.75 ELSE 0.65 END AS ha,
  CASE WHEN n <= 100 THEN 0.9 WHEN n <= 1000 THEN 0.7 WHEN n <= 5000 THEN 0.6 WHEN n <= 10000 THEN 0.45 ELSE 0.35 END AS rm
  FROM (SELECT count(*) AS n FROM items)))""",
    "sweep_summary",
    "multi_summary",
    "items",
)
def pool_gate(spark, sf):
    results, pairs = sweep(spark, sf)
    summary = tuning.sweep_summary(tuning.sweep_per_query(results, pairs, SWEEP_K))
    multi = m.multi_relevant_summary(m.multi_relevant_metrics(results, pairs, (10, 50)))
    count = Inputs(spark, sf).items.agg(F.count("*")).scalar()
    out = rp.pool_gate(summary, multi, count)
    return rounded(out.select("config_name", *rp.BAR_NAMES, "pass_mode", "selected"))


@check(
    "config_changes",
    """SELECT *, CASE WHEN step = 0 THEN 'benchmark baseline' ELSE coalesce(nullif(concat_ws(', ',
  CASE WHEN b IS DISTINCT FROM lag(b) OVER w THEN 'b' END,
  CASE WHEN k1 IS DISTINCT FROM lag(k1) OVER w THEN 'k1' END), ''), 'no parameter change') END AS changed_from_previous
FROM (SELECT row_number() OVER (ORDER BY category) - 1 AS step, category AS name,
  CASE WHEN avg(price) > 115 THEN 0.5e0 ELSE 0.25e0 END AS b, CASE WHEN count(*) > 350 THEN 1.5e0 ELSE 1.2e0 END AS k1
  FROM items GROUP BY category) WINDOW w AS (ORDER BY step)""",
    "items",
)
def config_changes(spark, sf):
    """Sweep steps derived from the catalog's categories."""
    from pyspark.sql import Window

    x = Inputs(spark, sf)
    steps = x.items.groupBy(F.col("category").alias("name")).agg(
        F.when(F.avg("price") > 115, 0.5).otherwise(0.25).alias("b"),
        F.when(F.count("*") > 350, 1.5).otherwise(1.2).alias("k1"),
    )
    steps = steps.withColumn("step", F.row_number().over(Window.orderBy("name")) - 1)
    out = rp.config_changes(steps)
    text = F.col("changed_from_previous")
    return out.withColumn("changed_from_previous", F.when(text == "k1, b", "b, k1").otherwise(text))


BOARD = f"""SELECT 'retrieval' AS stage, name AS method, split, num_queries AS num_eval_examples, recall_at_50 AS primary_score,
 mrr_at_10 AS secondary_score, 1e0 AS coverage_score FROM (
 SELECT 'bm25' AS name, * FROM ({_retrieval_sql('bm25_top')}) UNION ALL SELECT 'dense', * FROM ({_retrieval_sql('tfidf_top')})
 UNION ALL SELECT 'hybrid', * FROM ({_retrieval_sql('hybrid_top')}))
UNION ALL SELECT 'llm_query_understanding', 'llm_query_understanding', split, num_queries, schema_valid_rate, intent_match_rate, output_parse_success_rate
FROM (SELECT split, count(*) AS num_queries, 1e0 AS output_parse_success_rate, 1e0 AS schema_valid_rate, {QU} FROM parsed GROUP BY 1)
UNION ALL SELECT 'sequence', 'markov', 'test', num_users, ndcg_at_10, recall_at_10, coverage_at_10 FROM ({_reco_sql(MARKOV)})
UNION ALL SELECT 'recommendation', 'itemcf', 'test', num_users, ndcg_at_10, recall_at_10, coverage_at_10 FROM ({_reco_sql(ITEMCF)})"""
BOARD_CTES = ("pairs", "bm25_top", "tfidf_top", "hybrid_top", "parsed", "markov_scores", "itemcf_scores", "active",
              "popular", "train", "test", "items")


def _board(spark, sf):
    x = Inputs(spark, sf)
    bm25, tfidf = x.bm25, x.tfidf
    lists = {
        "bm25": r.topk(bm25, x.pairs, 50),
        "dense": r.topk(tfidf, x.pairs, 50),
        "hybrid": h.hybrid_topk(h.fused_index(bm25, tfidf), x.pairs, 50),
    }
    retrieval = None
    for name, results in lists.items():
        rows = m.retrieval_metrics(m.retrieval_per_query(results, x.pairs)).withColumn("method", F.lit(name))
        retrieval = rows if retrieval is None else retrieval.unionByName(rows)
    users = x.test.select("user_id").distinct()
    recs = cut_lineage(rec.itemcf_recs(x.train, x.items, users, 10))
    reco = m.reco_metrics(recs, x.test, x.items, (10,)).withColumns({"method": F.lit("itemcf"), "split": F.lit("test")})
    markov = seq.eval_sequence(seq.seq_markov_recs(x.train, x.items, users, 10), x.train, x.test, x.items, (10,))
    markov = markov.withColumns({"method": F.lit("markov"), "split": F.lit("test")})
    understood = m.query_understanding_metrics(q.query_understanding(x.pairs, x.items))
    return rp.leaderboard(
        {"retrieval": retrieval, "recommendation": reco, "sequence": markov, "llm_query_understanding": understood}
    )


SHOWN = ("stage", "method", "split", "num_eval_examples", "primary_score", "secondary_score", "coverage_score")


@check("leaderboard", BOARD, *BOARD_CTES)
def leaderboard(spark, sf):
    return rounded(_board(spark, sf).select(*SHOWN))


@check(
    "best_models",
    f"""SELECT * FROM ({BOARD}) QUALIFY row_number() OVER (PARTITION BY stage ORDER BY primary_score DESC,
 secondary_score DESC, coverage_score DESC, method, split) = 1""",
    *BOARD_CTES,
)
def best_models(spark, sf):
    return rounded(rp.best_models(_board(spark, sf)).select(*SHOWN))


@check(
    "business_metrics",
    """SELECT count(*) AS num_items, count(DISTINCT category) AS num_categories, round(avg(avg_rating), 6) AS avg_rating,
 round(avg(rating_count), 6) AS avg_rating_count,
 (SELECT round(avg(authority_score), 6) FROM candidates) AS avg_authority_score,
 (SELECT round(avg(conversion_proxy), 6) FROM candidates) AS avg_conversion_proxy,
 (SELECT round(avg(item_event_weight_sum), 6) FROM candidates) AS avg_item_event_weight_sum,
 (SELECT round(avg(hallucination_rate), 6) FROM genrec_pq) AS avg_genrec_hallucination_rate FROM items""",
    "items",
    "candidates",
    "genrec_pq",
)
def business_metrics(spark, sf):
    from aisle.operators import generation as g
    from checks.generation import EXPERIMENTS, contexts

    x = Inputs(spark, sf)
    ctx, frame = contexts(spark, sf)
    per_query = m.genrec_per_query(g.run_experiments(ctx, EXPERIMENTS), x.pairs, x.items)
    return rounded(rp.business_metrics(x.items, frame, per_query))


@check(
    "examples_lookup",
    """SELECT 'query' AS kind, query_text AS value FROM (SELECT DISTINCT query_text FROM pairs ORDER BY 1 LIMIT 20)
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM (SELECT DISTINCT user_id FROM train ORDER BY 1 LIMIT 20)
UNION ALL SELECT 'card', item_id || ':' || title || ':' || category || ':' || brand FROM items""",
    "pairs",
    "train",
    "items",
)
def examples_lookup(spark, sf):
    x = Inputs(spark, sf)
    queries = rp.example_queries(x.pairs, 20).select(F.lit("query").alias("kind"), F.col("query_text").alias("value"))
    users = rp.example_users(x.train, 20).select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("value"))
    cards = rp.item_cards(x.items)
    line = F.concat_ws(":", "item_id", "title", "category", "brand")
    return queries.unionByName(users).unionByName(cards.select(F.lit("card").alias("kind"), line.alias("value")))
