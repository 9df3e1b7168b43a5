"""Block search and the inverted-file index against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.operators import vector_index as vi
from aisle.operators import vectors as v


def plain_topk(queries, items, k, exclude=()):
    out = []
    for q, x in queries.items():
        scored = sorted((-round(float(np.dot(x, y)), 9), i) for i, y in items.items() if (q, i) not in exclude)
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["item_id"], r["score"], r["rank"]) for r in df.collect())


def unit(x):
    return x / (np.linalg.norm(x) or 1.0)


@pytest.fixture(scope="module")
def clustered():
    dice = np.random.default_rng(1)
    means = dice.normal(size=(30, 12))
    items = {i: means[i % 30] + 0.2 * dice.normal(size=12) for i in range(1500)}
    items.update({2000 + i: means[3] for i in range(700)})
    queries = {q: means[q % 30] + 0.2 * dice.normal(size=12) for q in range(40)}
    return queries, items


def frame(spark, data, name):
    return spark.createDataFrame([(k, [float(x) for x in vec]) for k, vec in data.items()], f"{name} long, vec array<double>")


def test_blocks_equal_one_product(spark, monkeypatch):
    dice = np.random.default_rng(2)
    items = {i: dice.integers(-2, 3, 5) for i in range(90)}
    queries = {q: dice.integers(-2, 3, 5) for q in range(30)}
    exclude = {(q, i) for q in range(0, 30, 2) for i in range(q, 90, 7)}
    pairs = spark.createDataFrame(sorted(exclude), "query_id long, item_id long")
    monkeypatch.setattr(v, "ITEM_BLOCK", 16)
    monkeypatch.setattr(v, "QUERY_BLOCK", 7)
    left, right = frame(spark, queries, "query_id"), frame(spark, items, "item_id")
    assert rows(v.block_topk(left, right, 6)) == plain_topk(queries, items, 6)
    assert rows(v.block_topk(left, right, 6, exclude=pairs)) == plain_topk(queries, items, 6, exclude)

    def sparse(df):
        places = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda p: F.get("vec", p) != 0)
        return df.select(
            df.columns[0], F.transform(places, lambda p: p * 1_000_000).alias("idx"),
            F.filter("vec", lambda x: x != 0).alias("val"),
        )

    assert rows(v.block_topk(sparse(left), sparse(right), 6)) == plain_topk(queries, items, 6)


def test_items_move_once(spark, clustered):
    queries, items = clustered
    plan = v.vector_topk(frame(spark, queries, "query_id"), frame(spark, items, "item_id"), 5)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1 and text.count("Join") == 0


def test_index_recall_and_reload(spark, clustered, monkeypatch, tmp_path):
    queries, items = clustered
    monkeypatch.setattr(vi, "BLOCK_ROWS", 256)
    index = vi.build_vector_index(frame(spark, items, "item_id"), k=20)
    assert len(index.centers) == vi.cell_count(len(items)) and index.probes < len(index.centers) / 2
    assert index.sizes.sum() == len(items) and index.sizes.max() > 256
    asked = frame(spark, queries, "query_id")
    found = rows(vi.ann_topk(index, asked, 20))
    exact = plain_topk({q: unit(x) for q, x in queries.items()}, {i: unit(x) for i, x in items.items()}, 20)
    best = {(q, rank): s for q, _, s, rank in exact}
    assert len(found) == len(exact)
    # copies of one vector tie, so scores are compared rather than ids
    assert np.mean([s >= best[q, 20] - 1e-8 for q, _, s, _ in found]) >= 0.9
    vi.save_vector_index(index, str(tmp_path / "index"))
    again = vi.load_vector_index(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and rows(vi.ann_topk(again, asked, 20)) == found


def test_index_of_few_and_no_items(spark):
    empty = spark.createDataFrame([], "item_id long, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vec array<double>")
    assert rows(vi.ann_topk(vi.build_vector_index(empty), asked)) == []
    assert v.vector_topk(asked.where("query_id = 1"), empty, 5).count() == 0
    few = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 0.0])], empty.schema)
    assert [r[1] for r in rows(vi.ann_topk(vi.build_vector_index(few, 2), asked, 3))] == [5, 6, 7]


def test_every_query_goes_to_few_blocks(spark, monkeypatch):
    """A block gives a list per query, so lists and copies of queries grow with the blocks."""
    items = spark.range(1)
    cores = spark.sparkContext.defaultParallelism
    assert v.item_blocks(items, 1_200_000, None)[0] == 19
    assert v.item_blocks(items, 1_200_000, 64)[0] == 19
    assert v.item_blocks(items, 5_000, 8) == (1, cores)
    rng = np.random.default_rng(3)
    vectors = {n: rng.normal(size=4).round(2).tolist() for n in range(90)}
    queries = {n: vectors[n] for n in range(25)}
    left = spark.createDataFrame(list(queries.items()), "query_id long, vec array<double>")
    right = spark.createDataFrame(list(vectors.items()), "item_id long, vec array<double>")
    for size in (32, 1024):
        monkeypatch.setattr(v, "BLOCK_BYTES", size * 32)
        monkeypatch.setattr(v, "ITEM_BLOCK", size)
        assert rows(v.block_topk(left, right, 5)) == plain_topk(queries, vectors, 5)
