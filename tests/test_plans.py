"""Rankers, retrievers and encoders by name."""

import pytest
from pyspark.sql import functions as F

from aisle.operators import ranking, tuning, vectors
from aisle.plans import evaluate
from aisle.plans.rankers import build_ranker
from aisle.plans.retrievers import build_retriever, encode_items


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "trail running shoes", "Sports", "Nova", 20.0, 4.5, 10, [1.0, 0.0]), (2, "moisture cream", "Beauty", "Luma", 5.0, 4.0, 3, [0.0, 1.0]),
        (3, "office lamp", "Electronics", "Orbit", 50.0, 3.5, 0, None), (4, "running socks", "Sports", "Nova", 8.0, 4.9, 80, [0.6, 0.8]),
    ]
    return spark.createDataFrame(
        rows, "item_id long, title string, category string, brand string, price double, avg_rating double, rating_count long, image_embedding array<double>"
    )


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("a", "running shoes"), ("b", "office lamp")], "query_id string, query_text string")


def firsts(df):
    return {r["query_id"]: r["item_id"] for r in df.where("rank = 1").collect()}


@pytest.mark.parametrize("method", ["bm25", "dense", "faiss", "hybrid", "text_only", "text_metadata_fusion", "multimodal_fusion"])
def test_text_retrievers_find_the_obvious_item(items, asked, method):
    assert firsts(build_retriever(method, items)(asked, 3)) == {"a": 1, "b": 3}


def test_vector_retriever_and_unknown_names(spark, items):
    held = items.withColumnRenamed("image_embedding", "vec")
    queries = held.where("vec is not null").select(F.col("item_id").cast("string").alias("query_id"), "vec")
    found = build_retriever("vector", held)(queries, 2)
    assert firsts(found) == {"1": 1, "2": 2, "4": 4}
    exact = vectors.vector_topk(queries, held.where("vec is not null").select("item_id", "vec"), 2)
    assert sorted(map(tuple, found.select(exact.columns).collect())) == sorted(map(tuple, exact.collect()))
    for wrong in ("metadata_only", "nothing"):
        with pytest.raises(ValueError):
            build_retriever(wrong, items)


def test_encoders_hold_the_blocks_they_name(items):
    blocks = {
        method: {r[0] for r in encode_items(method, items, image_weight=0.2)[1].select(F.substring_index("feature", ":", 1)).distinct().collect()}
        for method in ("text_only", "metadata_only", "text_metadata_fusion", "multimodal_fusion")
    }
    assert blocks == {
        "text_only": {"text"}, "metadata_only": {"meta"}, "text_metadata_fusion": {"text", "meta"},
        "multimodal_fusion": {"text", "meta", "image"},
    }
    norms = encode_items("multimodal_fusion", items)[1].groupBy("item_id").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms.collect())


def test_rankers_by_name(spark, items, tmp_path):
    rows = [(f"q{i}", "running shoes", i % 4 + 1, int(i % 4 in (0, 3)), "train", float(i % 4 == 0) + 0.1 * (i % 3), 0.5, 0.2, 0.1, "Sports") for i in range(40)]
    frame = spark.createDataFrame(
        rows, "query_id string, query_text string, candidate_item_id long, label int, split string, hybrid_score double, "
        "authority_score double, conversion_proxy double, cold_start_score double, category string",
    )
    mixed = build_ranker("mixed", frame)
    assert sorted(map(str, mixed.score(frame).collect())) == sorted(map(str, ranking.mixed_rank(frame).collect()))
    with pytest.raises(ValueError):
        mixed.save(str(tmp_path / "m"))
    text = build_ranker("pair_text", frame, items.withColumn("description", F.lit("")), features=1 << 10).score(frame)
    means = {r["label"]: r["m"] for r in text.groupBy("label").agg(F.avg("model_score").alias("m")).collect()}
    assert text.count() == 40 and means[1] > means[0] + 0.5
    for wrong in (("none", None), ("cross_encoder", None)):
        with pytest.raises(ValueError):
            build_ranker(wrong[0], frame, wrong[1])


def test_results_are_stored_as_versions(spark, tmp_path):
    root = str(tmp_path / "results")
    row = lambda method, score, **more: spark.createDataFrame([{"method": method, "split": "test", "config_path": "c", "score": score, **more}])
    assert evaluate.stored_results(spark, root) is None
    evaluate.record_results(row("a", 1.0), root)
    evaluate.record_results(row("b", 2.0, extra="x"), root)
    (tmp_path / "results" / "version=000002").mkdir()  # a writer that was lost
    evaluate.record_results(row("a", 3.0), root)
    got = {(r["method"], r["score"], r["extra"]) for r in evaluate.stored_results(spark, root).collect()}
    assert got == {("a", 3.0, None), ("b", 2.0, "x")}


def test_evaluate_and_sweep_by_method(spark, items):
    items = items.withColumn("description", F.lit(""))
    pairs = spark.createDataFrame(
        [("a", "running shoes", 1, "test", "title"), ("b", "office lamp", 3, "test", "title"), ("c", "office lamp", 4, "test", "brand"), ("d", "cream", 2, "val", "title")],
        "query_id string, query_text string, target_item_id long, split string, source string",
    )
    row = evaluate.evaluate_retrieval("bm25", items, pairs, k_values=(1, 3), config_path="c").first()
    assert (row["method"], row["split"], row["config_path"], row["num_queries"]) == ("bm25", "test", "c", 3)
    assert abs(row["recall_at_1"] - 2 / 3) < 1e-9
    with pytest.raises(ValueError):
        evaluate.evaluate_retrieval("bm25", items, pairs, split="none")
    configs = [{"name": "low", "method": "bm25", "settings": {"k1": 0.5}}, {"name": "fused", "method": "hybrid"}, {"name": "rerank", "method": "overlap_rerank"}]
    found = evaluate.sweep_retrievers(configs, items, pairs, 3)
    per_query = tuning.sweep_per_query(found, pairs, (1, 3))
    summary = {r["config_name"]: r for r in tuning.sweep_summary(per_query).collect()}
    assert set(summary) == {"low", "fused", "rerank"}
    assert all(r["num_queries"] == 4 and r["recall_at_1"] == 0.75 for r in summary.values())
    for wrong in ([], [configs[0], configs[0]]):
        with pytest.raises(ValueError):
            evaluate.sweep_retrievers(wrong, items, pairs)
