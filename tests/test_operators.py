"""Closed-form fixtures and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from aisle.functions import query_rules as rules
from aisle.functions import text as t
from aisle.operators import clean, explanations, generation as g, metrics as m
from aisle.operators import hybrid as h
from aisle.operators import representation as rep
from aisle.operators import retrieval as r
from aisle.operators import splits


@pytest.fixture(scope="module")
def items(spark):
    data = [
        (1, "trail running shoes", "Sports", "Nova", "light shoes"),
        (2, "moisture cream", "Beauty", "Luma", "for dry skin"),
        (3, "office lamp", "Electronics", "Orbit", "desk light"),
    ]
    return spark.createDataFrame(data, "item_id long, title string, category string, brand string, description string")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)], "query_id string, query_text string")


def ids(df, query):
    found = df.where(F.col("query_id") == query).orderBy("rank").collect()
    return [row["item_id"] for row in found]


def test_retrieval_orders_and_fills(spark, items):
    asked = queries(spark, "running shoes", "zzz unseen", "")
    for index in (r.bm25_index(items), r.tfidf_index(items)):
        top = r.topk(index, asked, 3)
        assert ids(top, "q0")[0] == 1
        assert ids(top, "q1") == [1, 2, 3] and ids(top, "q2") == [1, 2, 3]
    hybrid = h.hybrid_topk(h.fused_index(r.bm25_index(items), r.tfidf_index(items)), asked, 3)
    assert ids(hybrid, "q0")[0] == 1 and len(ids(hybrid, "q2")) == 3


def test_shuffled_term_join_equals_broadcast(spark, items, monkeypatch, hot):
    asked = queries(spark, "running shoes light", "desk light")
    index = r.bm25_index(items)
    plain = sorted(map(tuple, r.matched_scores(index, asked).collect()))
    monkeypatch.setattr("aisle.skew.fits_broadcast", lambda *a, **k: False)
    assert plain == sorted(map(tuple, r.matched_scores(index, asked).collect()))


def test_field_weights(spark):
    data = [(1, "red lamp", "x"), (2, "blue chair", "red red red lamp lamp")]
    two = spark.createDataFrame(data, "item_id long, title string, description string")
    index = r.bm25_index(two, field_weights={"title": 9.0, "description": 0.1})
    assert ids(r.topk(index, queries(spark, "red lamp"), 2), "q0")[0] == 1


def test_query_rules(spark):
    texts = ["cheap shoes", "shoes under $49.5", "gift", "nova ring", "beauty", "ring", " "]
    df = queries(spark, *texts)
    out = df.select(
        rules.classify_intent("query_text").alias("i"), rules.extract_price("query_text").alias("p")
    ).collect()
    assert [x["i"] for x in out] == [
        "price_sensitive_search", "price_sensitive_search", "use_case_search", "brand_search",
        "category_search", "product_search", "unknown",
    ]
    assert [x["p"] for x in out][:2] == ["cheap", "under_49_5"]
    short = df.select(t.truncate_text(F.lit("a " * 300)).alias("s")).first()["s"]
    assert len(short) <= 240 and short.endswith("...")


def test_leave_one_out_small_users(spark):
    data = [(1, "a", 1, 10), (2, "b", 1, 10), (3, "b", 2, 20), (4, "c", 1, 10), (5, "c", 2, 10), (6, "c", 3, 30)]
    df = spark.createDataFrame(data, "event_id long, user_id string, item_id long, ts long")
    df = df.withColumn("timestamp", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    got = {row["event_id"]: row["split"] for row in splits.leave_one_out(df).collect()}
    assert got == {1: "test", 2: "val", 3: "test", 4: "train", 5: "val", 6: "test"}


def test_ranking_metrics_closed_form(spark):
    data = [("q1", 1, 0, 0.9), ("q1", 2, 1, 0.5), ("q1", 3, 0, 0.1), ("q2", 1, 0, 0.7)]
    df = spark.createDataFrame(data, "query_id string, candidate_item_id long, label int, model_score double")
    q1 = m.ranking_per_query(df, (2, 3)).where("query_id = 'q1'").first()
    assert q1["mrr_at_3"] == 0.5 and q1["precision_at_2"] == 0.5 and q1["recall_at_2"] == 1.0
    assert abs(q1["ndcg_at_3"] - 1 / math.log2(3)) < 1e-12
    summary = m.ranking_metrics(df, k_values=(2,)).first()
    assert summary["candidate_coverage"] == 0.5
    by_query = {row["query_id"]: row["auc"] for row in m.auc(df, ["query_id"]).collect()}
    assert by_query == {"q1": 0.5, "q2": None}


def test_auc_ties_equal_pairwise_definition(spark):
    data = [("q", i, int(i % 3 == 0), float(i % 4)) for i in range(24)]
    df = spark.createDataFrame(data, "query_id string, candidate_item_id long, label int, model_score double")
    up = [s for _, _, y, s in data if y]
    down = [s for _, _, y, s in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert abs(m.auc(df).first()["auc"] - want) < 1e-12


def test_auc_counts_rows_per_score_and_needs_no_row_ids(spark):
    data = [(g, i % 2, s) for g in ("a", None) for i, s in enumerate([0.25, 0.5, 0.5, None, 0.75, -0.0, 0.0, 0.1])]
    df = spark.createDataFrame(data * 3, "g string, label int, s double")
    rank = lambda s: float("-inf") if s is None else s
    up = [rank(s) for g, y, s in data if y and g]
    down = [rank(s) for g, y, s in data if not y and g]
    want = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    found = {x["g"]: x["auc"] for x in m.auc(df, ["g"], "s").collect()}
    assert set(found) == {"a", None} and all(abs(v - want) < 1e-12 for v in found.values())


def test_multi_relevant(spark):
    results = spark.createDataFrame(
        [("c", "x", i, n) for n, i in enumerate([9, 1, 8, 2], 1)], "config_name string, query_text string, item_id long, rank int"
    )
    pairs = spark.createDataFrame([("x", 1), ("x", 5)], "query_text string, target_item_id long")
    row = m.multi_relevant_metrics(results, pairs, (1, 3)).first()
    assert (row["hit_any_at_1"], row["hit_any_at_3"]) == (0.0, 1.0)
    assert (row["recall_multi_at_3"], row["mrr_any_at_3"]) == (0.5, 0.5)


def test_metadata_unseen_category_is_zero(spark):
    kind = "item_id long, category string, brand string, price double, avg_rating double, rating_count long"
    fitted = spark.createDataFrame([(1, "A", "x", 1.0, 4.0, 3), (2, "B", "y", 3.0, 5.0, 9)], kind)
    other = spark.createDataFrame([(3, "Z", "x", None, None, None)], kind)
    names = {row["feature"] for row in rep.metadata_vectors(other, fitted).collect()}
    assert names == {"brand=x", "price", "avg_rating", "rating_count", "log_rating_count"}


def test_generation_parse_validate_fallback(spark):
    kind = "query_id string, output_text string, candidates array<struct<item_id:string>>"
    shown = [("i1",), ("i2",)]
    data = [
        ("plain", '{"recommended_item_ids": ["i2", "i2", " i1 "]}', shown),
        ("fenced", 'x ```json\n{"ranked_items": [{"item_id": "i1", "reason": "r", "confidence": 0.5}]}\n``` y', shown),
        ("broken", "{oops", shown),
        ("list", "[1]", shown),
        ("stray", '{"recommended_item_ids": ["i1", "nope"]}', shown),
        ("type", '{"recommended_item_ids": "i1", "ranked_items": []}', shown),
    ]
    df = spark.createDataFrame(data, kind)
    checked = g.validate_ids(g.parse_recommendations(df), g.candidate_ids())
    out = {row["query_id"]: row for row in g.fallback_to_candidates(checked).collect()}
    assert out["plain"]["recommended_item_ids"] == ["i2", "i1"] and not out["plain"]["used_fallback"]
    assert out["fenced"]["ranked_items"][0]["reason"] == "r"
    for name in ("broken", "list"):
        assert not out[name]["parse_success"] and out[name]["used_fallback"]
        assert out[name]["recommended_item_ids"] == ["i1", "i2"]
    assert out["stray"]["invalid_item_ids"] == ["nope"] and not out["stray"]["schema_valid"]
    assert out["type"]["parse_success"] and out["type"]["recommended_item_ids"] == []


def test_faithfulness_counts_foreign_claims(spark):
    evidence = spark.createDataFrame(
        [("q", 0, "i1", "Sports", "Nova"), ("q", 1, "i2", "Beauty", "Luma")],
        "query_id string, place int, item_id string, category string, brand string",
    )
    kind = "query_id string, explanations array<struct<item_id:string,explanation:string,evidence_item_ids:array<string>>>"
    said = [("i1", "A Sports item from Luma", ["i1"]), ("i2", "A Beauty item", ["i9"]), ("i1", "Sports by Nova", ["i1"])]
    row = explanations.faithfulness(spark.createDataFrame([("q", said)], kind), evidence).first()
    assert (row["ungrounded_claim_count"], row["missing_evidence_count"]) == (1, 1)
    assert not row["explanation_faithful"]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1,)], "item_id long")
    with pytest.raises(ValueError):
        clean.require_columns(df, clean.ITEM_COLUMNS, "items")


def test_stream_equals_batch(spark, tmp_path):
    from aisle.operators.ranking import item_popularity
    from aisle.streaming.aggregates import combine_windows, windowed_item_popularity

    data = [(i, i % 3, i * 600, ("view", "purchase")[i % 2], 1.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "event_id long, item_id long, ts long, event_type string, event_weight double")
    df = df.withColumn("timestamp", F.timestamp_seconds("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        windowed_item_popularity(stream).writeStream.outputMode("complete").format("memory")
        .queryName("popularity").option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, combine_windows(spark.table("popularity")).collect()))
    assert got == sorted(map(tuple, item_popularity(df).collect()))


def test_registry_pairs_names():
    from __spark_entry__ import oracle_sql, queries as registered

    assert set(oracle_sql()) <= set(registered()) and len(registered()) > 100


def test_registered_rankers_keep_the_operators_iterations(monkeypatch):
    from checks import ranking

    class Stop(Exception):
        pass

    def train(frame, *method, **settings):
        assert not settings
        raise Stop

    monkeypatch.setattr(ranking, "candidate_frame", lambda spark, sf: None)
    monkeypatch.setattr(ranking, "cut_lineage", lambda frame: frame)
    monkeypatch.setattr(ranking.k, "train_ranker", train)
    monkeypatch.setattr(ranking.k, "mlp_ranker", train)
    for query in (ranking.gbt_ranker, ranking.mlp_ranker):
        with pytest.raises(Stop):
            query(None, "")


def test_rankers_fit_on_few_partitions_with_every_row(spark, monkeypatch):
    from aisle.operators import ranking as operators

    given = []
    monkeypatch.setattr(operators.Pipeline, "fit", lambda self, rows: given.append(rows))
    frame = spark.range(0, 1200, 1, 60).selectExpr(
        "cast(id % 2 as int) as label", "id * 0.5D as hybrid_score", "if(id % 4 = 0, 'test', 'train') as split"
    )
    for method in ("linear", "gbt", "mlp"):
        operators.train_ranker(frame, method)
    monkeypatch.setattr(operators, "FIT_ROWS", 30)
    operators.train_ranker(frame, "linear")
    few = 2 * spark.sparkContext.defaultParallelism
    assert [rows.count() for rows in given] == [900] * 4
    assert [rows.rdd.getNumPartitions() for rows in given] == [few, few, few, 30]
