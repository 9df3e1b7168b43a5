"""Lists over the whole catalog: signs of scores, unscored items, ids of any type."""

from aisle.operators import generation as g
from aisle.operators import recommend as rec


def lists(df):
    rows = sorted(df.collect(), key=lambda r: (r.user_id, r["rank"]))
    out = {}
    for r in rows:
        out.setdefault(r.user_id, []).append(r.item_id)
        assert r["rank"] == len(out[r.user_id])
    return out


def test_negative_scores_come_behind_unscored_items(spark):
    catalog = spark.createDataFrame([(i,) for i in range(1, 7)], "item_id long")
    scores = spark.createDataFrame(
        [(1, 1, -1.0), (1, 2, -0.5), (1, 5, 2.0), (1, 99, 9.0), (2, 3, -2.0), (2, 1, 0.0)],
        "user_id long, item_id long, score double",
    )
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    seen = spark.createDataFrame([(1, 4), (3, 1)], "user_id long, item_id long")
    got = rec.rank_unseen(scores, users, seen, catalog, 5)
    assert lists(got) == {1: [5, 3, 6, 2, 1], 2: [1, 2, 4, 5, 6], 3: [2, 3, 4, 5, 6]}
    assert [r.score for r in got.where("user_id = 1").orderBy("rank").collect()] == [2.0, 0.0, 0.0, -0.5, -1.0]
    assert lists(rec.rank_unseen(scores, users, seen, catalog, 3))[1] == [5, 3, 6]


def test_factor_lists_take_text_ids_and_fill(spark):
    rows = [(f"u{u}", f"i{i}", 1.0) for u in range(4) for i in range(4) if (u + i) % 4]
    train = spark.createDataFrame(rows, "user_id string, item_id string, event_weight double")
    catalog = spark.createDataFrame([(f"i{i}",) for i in range(8)], "item_id string")
    users = spark.createDataFrame([("u0",), ("u1",), ("new",)], "user_id string")
    model = rec.mf_model(train, factors=2, iterations=3)
    got = lists(rec.mf_recs(model, train, catalog, users, 3))
    seen = {u: {i for v, i, _ in rows if v == u} for u in ("u0", "u1", "new")}
    assert set(got) == {"u0", "u1", "new"}
    for user, items in got.items():
        assert len(set(items)) == 3 and not seen[user] & set(items)
        assert set(items) <= {f"i{i}" for i in range(8)}


def test_ranked_entries_of_another_type_cost_no_others(spark):
    text = '{"recommended_item_ids":["1","2"],"ranked_items":["x",5,{"item_id":"3","confidence":0.5},{"item_id":4}]}'
    df = spark.createDataFrame([(text,), ('{"ranked_items":{"item_id":"1"}}',)], "output_text string")
    rows = {r.output_text: r for r in g.parse_recommendations(df).collect()}
    assert rows[text].recommended_item_ids == ["1", "2", "3", "4"]
    assert [r.confidence for r in rows[text].ranked_items] == [0.0, 0.0, 0.5, 0.0]
    assert rows['{"ranked_items":{"item_id":"1"}}'].recommended_item_ids == []
