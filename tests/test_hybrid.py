"""Block search with bounds against plain sums over every pair."""

import random

import pytest
from pyspark.sql import functions as F

from aisle.operators import hybrid as h
from aisle.operators import retrieval as r
from aisle.operators.splits import item_index


@pytest.fixture(scope="module")
def catalog(spark):
    dice = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        n = dice.choice([1, 3, 6, 12])
        text = " ".join(dice.choices(words, weights=[1 / (j + 1) for j in range(40)], k=n))
        rows.append((i, f"all {text}"))
    rows += [(700 + i, "all w3 w5") for i in range(40)]
    return spark.createDataFrame(rows, "item_id long, title string")


@pytest.fixture(scope="module")
def queries(spark):
    dice = random.Random(9)
    texts = [" ".join(f"w{dice.randrange(40)}" for _ in range(dice.choice([1, 2, 4]))) for _ in range(25)]
    texts += ["all", "all w1", "w3 w5", "none of these", "", "w39 w38"]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query_text string")


def ranked(df):
    return sorted((x["query_text"], x["rank"], x["item_id"], round(x["score"], 8)) for x in df.collect())


@pytest.mark.parametrize("normalization, weights", [("minmax", (0.5, 0.5)), ("none", (0.3, 0.9)), ("minmax", (1.0, 0.0))])
def test_blocks_give_the_exact_lists(spark, catalog, queries, monkeypatch, normalization, weights):
    monkeypatch.setattr(h, "BLOCK_ITEMS", 40)
    bm25, tfidf = r.bm25_index(catalog), r.tfidf_index(catalog, max_features=30)
    texts = r.distinct_texts(queries)
    every = r.hybrid_scores(bm25, tfidf, texts, *weights, normalization).where("score > 0")
    want = ranked(r.best_first("query_text", "score", 7, every))
    read = []
    plain = h._read
    monkeypatch.setattr(h, "_read", lambda index, chosen, *a: read.append(chosen.count()) or plain(index, chosen, *a))
    index = h.fused_index(bm25, tfidf)
    got = ranked(h.fused_search(index, texts, 7, *weights, normalization).top)
    assert got == want
    blocks = index.bounds.join(h.encoded_texts(index, texts), "term").select("query_text", "block").distinct()
    assert sum(read) < blocks.count()


def test_full_lists_and_bad_settings(spark, catalog, queries):
    index = h.fused_index(r.bm25_index(catalog), r.tfidf_index(catalog))
    top = h.hybrid_topk(index, queries, 5)
    assert {x["n"] for x in top.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {5}
    for wrong in ({"normalization": "rank"}, {"bm25_weight": -1.0}):
        with pytest.raises(ValueError):
            h.hybrid_topk(index, queries, 5, **wrong)


def test_catalog_ranks_are_counted(spark, catalog, queries, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(h, "RANKED_AT_ONCE", 9)
    bm25, tfidf = r.bm25_index(catalog), r.tfidf_index(catalog, max_features=30)
    texts = r.distinct_texts(queries)
    index = h.fused_index(bm25, tfidf)
    search = h.fused_search(index, texts, 7)
    places = item_index(catalog)
    wanted = texts.crossJoin(catalog.where("item_id % 7 = 0").select("item_id"))
    got = h.catalog_ranks(index, search, wanted, places).collect()
    every = r.hybrid_scores(bm25, tfidf, texts).withColumnRenamed("score", "hybrid_score")
    full = texts.crossJoin(catalog.select("item_id")).join(every, ["query_text", "item_id"], "left").na.fill(0.0)
    by_text = {}
    for x in full.collect():
        by_text.setdefault(x["query_text"], []).append(x)
    assert len(got) == wanted.count()
    for kind in h.KINDS:
        want = {}
        for text, rows in by_text.items():
            rows = sorted(rows, key=lambda x: (-x[f"{kind}_score"], x["item_id"]))
            want.update({(text, x["item_id"]): n for n, x in enumerate(rows, 1)})
        assert all(x[f"{kind}_rank"] == want[x["query_text"], x["item_id"]] for x in got), kind


@pytest.mark.parametrize("at_once", [9, 1024])
def test_wanted_items_of_a_text_are_not_sent_to_every_block(spark, catalog, queries, monkeypatch, at_once):
    monkeypatch.setattr(h, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(h, "ID_BLOCK_ITEMS", 50)
    monkeypatch.setattr(h, "RANKED_AT_ONCE", at_once)
    catalog = catalog.union(spark.createDataFrame([(-1, ""), (350_000, "?"), (655, "")], catalog.schema))
    sent = []

    def watched(held, asking, keys, task, schema):
        sent.append(asking.select(F.coalesce(F.size("wanted"), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return streamed(held, asking, keys, task, schema)

    streamed = h.streamed
    index = h.fused_index(r.bm25_index(catalog), r.tfidf_index(catalog, max_features=30))
    texts = queries.where("query_text in ('all', 'all w1', 'w3 w5', 'w39 w38', 'none of these')").select("query_text")
    search = h.fused_search(index, texts, 7)
    monkeypatch.setattr(h, "streamed", watched)
    wanted = texts.crossJoin(catalog.select("item_id"))
    got = h.catalog_ranks(index, search, wanted, item_index(catalog)).collect()
    assert len(got) == wanted.count() and len({(x["query_text"], x["item_id"]) for x in got}) == len(got)
    size = catalog.count()
    for text in {x["query_text"] for x in got}:
        mine = [x for x in got if x["query_text"] == text]
        for kind in h.KINDS:
            best = sorted(mine, key=lambda x: (-x[f"{kind}_score"], x["item_id"]))
            assert [x[f"{kind}_rank"] for x in best] == list(range(1, size + 1)), (text, kind)
    if at_once == 9:
        assert max(sent) <= wanted.count()
