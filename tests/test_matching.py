"""Lists from blocks against plain sums, layouts that move no candidate row, results read once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.operators import explanations as ex
from aisle.operators import matching
from aisle.operators import metrics as m
from aisle.operators import ranking as k
from aisle.operators import reports as rp
from aisle.operators import retrieval as r
from aisle.operators import vector_index as vi
from aisle.session import keep_columns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def catalog(spark):
    dice = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(dice.choices(words, k=dice.choice([1, 3, 5]))), float(i % 4)) for i in range(120)]
    rows += [(None, "w1 w2", 5.0), (7, "w3", 9.0)]
    return spark.createDataFrame(rows, "item_id long, title string, avg_rating double")


def test_blocks_give_the_best_of_all_pairs(spark, catalog, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ITEMS", 20)
    texts = spark.createDataFrame([("w1 w2 w2",), ("w3",), ("none",), (None,), ("w5 w6",)], "query_text string")
    for index in (r.bm25_index(catalog), r.tfidf_index(catalog)):
        every = r.best_first("query_text", "score", 6, r.matched_scores(index, texts).where("score > 0"))
        found = r.topk_texts(index, texts, 6, fill=False)
        assert found.columns == ["query_text", "item_id", "score", "rank"]
        assert sorted(map(str, found.collect())) == sorted(map(str, every.select(found.columns).collect()))


def test_blocks_keep_configurations_apart_and_ties_in_order(spark):
    rows = [(c, i, "a", 1.0 + (c == "y") * i, float(i % 3)) for c in "xy" for i in range(9)]
    postings = spark.createDataFrame(rows, "c string, item_id long, term string, weight double, rating double")
    wanted = spark.createDataFrame([("x", "q", "a", 2.0), ("y", "q", "a", 1.0)], "c string, query_text string, term string, weight double")
    got = matching.best_matches(postings, wanted, 3, 9, ["c"], "rating").orderBy("c", "rank").collect()
    assert [(x.c, x.item_id, x.score) for x in got] == [
        ("x", 2, 2.0), ("x", 5, 2.0), ("x", 8, 2.0), ("y", 8, 9.0), ("y", 7, 8.0), ("y", 6, 7.0)
    ]


def test_steps_per_query_move_no_candidate_row(spark):
    items = spark.createDataFrame(
        [(i, f"thing w{i % 5}", "Beauty", "Nova", 5.0 + i, 4.0, i, "plain thing") for i in range(30)],
        "item_id long, title string, category string, brand string, price double, avg_rating double, "
        "rating_count long, description string",
    )
    pairs = spark.createDataFrame(
        [(f"q{i}", f"thing w{i % 5}", "train", i) for i in range(30)],
        "query_id string, query_text string, split string, target_item_id long",
    )
    train = spark.createDataFrame([(1, 2.0, "view")], "item_id long, event_weight double, event_type string")
    frame = k.ranking_features(pairs, items, train, r.bm25_index(items), r.tfidf_index(items), pool=5)
    for step in (k.mixed_rank(frame), k.top_candidates(frame, 3), k.candidate_stats(frame)):
        above = plan_of(step).split("Union")[0]
        moved = [x for x in above.splitlines() if "Exchange hashpartitioning(query_id" in x]
        assert not moved
    assert frame.groupBy("query_id").count().where("count < 5").isEmpty()


def test_top_candidates_count_an_item_once(spark):
    rows = [("q", 1, 0.9), ("q", 1, 0.8), ("q", 2, 0.7), ("q", None, 0.6), ("q", None, 0.5), ("q", 3, 0.4)]
    frame = spark.createDataFrame(rows, "query_id string, candidate_item_id long, hybrid_score double")
    got = k.top_candidates(frame, 3).orderBy("candidate_rank").collect()
    assert [(x.candidate_item_id, x.hybrid_score) for x in got] == [(1, 0.9), (2, 0.7), (None, 0.6)]
    assert "REPARTITION" not in plan_of(k.top_candidates(frame, 3))


def test_evidence_takes_only_recommended_candidates(spark):
    recs = spark.createDataFrame([("q", ["1", "2"]), ("p", ["3"])], "query_id string, recommended_item_ids array<string>")
    items = spark.createDataFrame(
        [(i, f"t{i}", "c", "b", 1.0, 2.0, 3) for i in (1, 2)],
        "item_id long, title string, category string, brand string, price double, avg_rating double, rating_count long",
    )
    cands = spark.createDataFrame(
        [("q", 1, 0.5), ("q", 9, 0.4), ("p", 3, 0.3)], "query_id string, candidate_item_id long, hybrid_score double"
    )
    out = ex.select_evidence(recs, items, cands)
    got = sorted((x.query_id, x.place, x.item_id, x.retrieval_score, x.title) for x in out.collect())
    assert got == [("p", 0, "3", 0.3, ""), ("q", 0, "1", 0.5, "t1"), ("q", 1, "2", 0.0, "t2")]
    assert "LeftSemi" in plan_of(out)


def test_targets_found_as_by_the_plain_join(spark):
    results = spark.createDataFrame(
        [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 5, 1), (None, 1, 1)], "query_id string, item_id long, rank int"
    )
    pairs = spark.createDataFrame([("a", 2), ("a", 2), ("b", 1), ("c", 1), (None, 1), ("b", None)], "query_id string, target_item_id long")
    got = sorted((str(x.query_id), str(x.target_item_id), x.target_rank or 0, x.num_results) for x in m.target_ranks(results, pairs).collect())
    assert got == [
        ("None", "1", 0, 0), ("a", "2", 2, 3), ("a", "2", 2, 3), ("a", "2", 3, 3), ("a", "2", 3, 3),
        ("b", "1", 0, 1), ("b", "None", 0, 1), ("c", "1", 0, 0),
    ]
    assert plan_of(m.target_ranks(results, pairs)).count("BroadcastHashJoin") >= 2


def test_a_board_is_read_once(spark):
    rows = spark.range(3).select(F.lit("m").alias("method"), F.col("id").cast("double").alias("recall_at_50"))
    board = rp.leaderboard({"retrieval": rows})
    assert "Range" not in plan_of(board)
    assert [x.primary_score for x in board.collect()] == [2.0, 1.0, 0.0]


def test_bins_hold_neighbouring_cells():
    sizes = np.array([0, 5, 5, 5, vi.BLOCK_ROWS * 2 + 1, 4, 0, 6, 1])
    first = vi._bins(sizes, 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5, 5, 6]


def test_kept_columns_are_read_alone(spark):
    kept = keep_columns(spark.range(5).select("id", F.lit("x").alias("wide")), "test")
    assert kept.schema["id"].dataType.simpleString() == "bigint" and kept.count() == 5
    assert "wide" not in plan_of(kept.select("id")).split("ReadSchema")[1]
