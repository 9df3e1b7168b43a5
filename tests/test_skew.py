"""The split and salted paths give the plain results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators import recommend as rec
from aisle.operators import splits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def events(spark):
    """User 0 holds more than a third of all rows."""
    base = spark.range(120).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 7).alias("user_id"),
        (F.col("id") * 7 % 13).alias("item_id"),
        F.timestamp_seconds(F.col("id") * 3 % 50).cast("timestamp_ntz").alias("timestamp"),
        F.lit("view").alias("event_type"),
        (F.col("id") % 4 + 1).cast("double").alias("event_weight"),
    )
    return base


def test_salted_join_equals_plain(spark, hot):
    left = events(spark)
    right = spark.range(5).select(F.col("id").alias("user_id"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew.join(left, right, "user_id", how, keys_from=left)
        assert rows(salted.select(*left.columns)) == rows(
            left.join(right, "user_id", how).select(*left.columns)
        )


def test_ranged_row_number_equals_window(spark, hot):
    df = events(spark)
    order = [F.col("timestamp"), F.col("event_id")]
    got = skew.row_number(df, "user_id", order, "n", ["event_id"])
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    assert rows(got.select("event_id", "n")) == rows(want.select("event_id", "n"))


def test_global_row_number(spark):
    ids = spark.range(1000).select((F.col("id") * 37 % 1009).alias("item_id"))
    got = skew.row_number(ids, [], [F.col("item_id")], "n", ["item_id"])
    values = [r["item_id"] for r in got.orderBy("n").collect()]
    assert values == sorted(values)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 1001))


def test_negative_sampling_hot_equals_plain_and_is_unseen(spark):
    df, catalog = events(spark), spark.range(40).select(F.col("id").alias("item_id"))
    plain = rows(splits.negative_sampling(df, catalog, 5))
    spark.conf.set("spark.aisle.hotGroupRows", "3")
    ranged = rows(splits.negative_sampling(df, catalog, 5))
    spark.conf.unset("spark.aisle.hotGroupRows")
    assert plain == ranged
    out = splits.negative_sampling(df, catalog, 5)
    pairs = {(r["user_id"], r["item_id"]) for r in df.collect()}
    drawn = out.collect()
    assert len(drawn) == 120 * 5
    assert all((r["user_id"], r["negative_item_id"]) not in pairs for r in drawn)
    assert len({(r["event_id"], r["negative_item_id"]) for r in drawn}) == len(drawn)


def test_popularity_and_itemcf_hot_equal_plain(spark):
    df, catalog = events(spark), spark.range(20).select(F.col("id").alias("item_id"))
    users = spark.range(9).select(F.col("id").alias("user_id"))
    runs = (
        lambda: rec.popularity_recs(df, catalog, users, 5),
        lambda: rec.itemcf_similarity(df, max_neighbors=4),
        lambda: splits.sequence_positions(df).select("event_id", "position"),
    )
    for run in runs:
        plain = rows(run())
        spark.conf.set("spark.aisle.hotGroupRows", "3")
        split = rows(run())
        spark.conf.unset("spark.aisle.hotGroupRows")
        assert plain == split and plain


def test_hot_keys_are_counted_once_and_salts_follow_counts(spark, hot, monkeypatch):
    left = events(spark).where("user_id >= 0")
    counted = []
    plain = skew.hot_of_counts
    monkeypatch.setattr(skew, "hot_of_counts", lambda *a: counted.append(1) or plain(*a))
    found = skew.hot_groups(left, "user_id")
    again = skew.hot_groups(events(spark).where("user_id >= 0"), "user_id")
    assert again is found and len(counted) == 1
    assert {r["user_id"]: r["_rows"] for r in found.collect()}[0] == 60 + len(range(63, 120, 7))
    right = spark.range(5).select(F.col("id").alias("user_id"))
    plan = skew.join(left, right, "user_id", hot=found).select("user_id", "event_id")
    assert rows(plan) == rows(left.join(right, "user_id").select("user_id", "event_id"))


def test_only_groups_of_some_share_are_hot(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3_000_000), ("c", 90_000_000_000)], "k string, _rows long")
    assert [r["k"] for r in skew.hot_of_counts(counts, 1_000_000).collect()] == ["c"]
    assert sorted(r["k"] for r in skew.hot_of_counts(counts.where("k <> 'c'"), 3).collect()) == ["b"]
    assert skew.hot_of_counts(counts, 10**12) is None


def test_cut_histories_equal_whole_windows(spark, hot, monkeypatch):
    df = events(spark)
    catalog = spark.range(13).select(F.col("id").alias("item_id"))
    index = splits.item_index(catalog)
    whole = rows(splits.prefix_examples(df, index, 4, with_seen=False))
    monkeypatch.setattr(splits.last_rows, "__defaults__", (5,))
    assert rows(splits.prefix_examples(df, index, 4, with_seen=False)) == whole
    inputs = {(r[0], r[1]): r[2] for r in whole}
    placed = {(r["user_id"], r["position"]): r["item_idx"] for r in splits.encode_interactions(splits.sequence_positions(df), index).collect()}
    for (user, position), got in inputs.items():
        assert got == [placed.get((user, p), 0) for p in range(position - 4, position)]
    full = {r["user_id"]: r for r in splits.user_sequences(df).collect()}
    parts = sorted(splits.user_sequences(df, part_rows=7).collect(), key=lambda r: (r["user_id"], r["part"]))
    assert max(r["sequence_length"] for r in parts) == 7
    for user, want in full.items():
        mine = [r for r in parts if r["user_id"] == user]
        for name in ("item_sequence", "timestamp_sequence", "event_weight_sequence"):
            assert sum((r[name] for r in mine), []) == want[name]
    held = df.where("event_id % 10 = 0")
    assert "seen_ids" not in splits.eval_examples(df, held, index, with_seen=False).columns
