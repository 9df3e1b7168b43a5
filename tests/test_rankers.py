"""Fits on equal rows that stand for their number."""

import math

from pyspark.sql import functions as F

from aisle.operators import ranking


def _candidates(spark, copies):
    """Rows whose number grows with ``copies`` while their values do not."""
    return spark.range(0, 400 * copies, 1, 4).select(
        (F.col("id") % 400).alias("_n"), F.concat(F.lit("q"), F.col("id")).alias("query_id")
    ).select(
        "query_id",
        F.concat(F.lit("red shoe "), (F.col("_n") % 7).cast("string")).alias("query_text"),
        (F.col("_n") % 40).alias("candidate_item_id"),
        F.lit("train").alias("split"),
        ((F.col("_n") * 7919) % 5 < 2).cast("int").alias("label"),
        ((F.col("_n") * 31) % 17 / 3.0 + F.when((F.col("_n") * 7919) % 5 < 2, 2.0).otherwise(0.0)).alias("hybrid_score"),
        F.when(F.col("_n") % 3 != 0, (F.col("_n") % 11).cast("double")).alias("price"),
        F.lit(4.0).alias("avg_rating"),
    )


def _close(left, right, digits):
    return all(math.isclose(a, b, rel_tol=10.0**-digits, abs_tol=10.0**-digits) for a, b in zip(left, right, strict=True))


def test_a_linear_fit_of_weighted_rows_is_that_of_all_rows(spark, monkeypatch):
    given = []
    frame = _candidates(spark, 5)
    own = ranking.Pipeline.fit
    monkeypatch.setattr(ranking.Pipeline, "fit", lambda self, rows: given.append(rows.count()) or own(self, rows))
    model = ranking.train_ranker(frame, "linear")
    assert given[0] < 400
    names = ranking.numeric_feature_columns(frame)
    assembled = ranking.VectorAssembler(inputCols=names, outputCol="raw_features").transform(frame.na.fill(0.0, names))
    scaler = ranking.StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(assembled)
    plain = ranking.LogisticRegression(regParam=0.001, maxIter=100).fit(scaler.transform(assembled))
    assert _close(model.stages[1].mean, scaler.mean, 9) and _close(model.stages[1].std, scaler.std, 9)
    assert _close(model.stages[2].coefficients, plain.coefficients, 4)
    assert math.isclose(model.stages[2].intercept, plain.intercept, abs_tol=1e-4)


def test_trees_and_text_pairs_are_fitted_and_scored_on_repeated_rows(spark):
    frame = _candidates(spark, 3)
    trees = ranking.score_candidates(ranking.train_ranker(frame, "gbt", maxIter=2), frame)
    items = spark.range(0, 40).select(
        F.col("id").alias("item_id"), F.concat(F.lit("shoe "), F.col("id") % 9).alias("title"),
        F.lit("red").alias("category"), F.lit("nova").alias("brand"), F.lit("").alias("description"),
    )
    model = ranking.pair_text_ranker(frame, items, features=1 << 10)
    rows = frame.unionByName(frame.limit(1).withColumns({"query_id": F.lit("new"), "query_text": F.lit("blue hat")}))
    pairs = ranking.score_pair_text(model, rows, items)
    direct = model.transform(ranking._pair_tokens(rows, items, ["query_id"]))
    direct = direct.select("query_id", ranking.vector_to_array("probability")[1].alias("s"))
    assert trees.count() == 1200 and pairs.count() == 1201
    both = pairs.join(direct, "query_id")
    assert both.where(F.abs(F.col("model_score") - F.col("s")) < 1e-12).count() == 1201


def test_large_weights_are_split_evenly(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 89.0)], "n int, _weight double")
    ones = ranking._split(rows, 100.0)
    assert ones.count() == 100 and ones.where("_weight <> 1").isEmpty()
    monkeypatch.setattr(ranking, "SPLIT_ROWS", 20)
    some = ranking._split(rows, 100.0)
    assert some.where("_weight > 5").isEmpty() and some.count() == 1 + 2 + 18
    sums = {r["n"]: r["s"] for r in some.groupBy("n").agg(F.sum("_weight").alias("s")).collect()}
    assert all(math.isclose(sums[n], s) for n, s in ((1, 1.0), (2, 10.0), (3, 89.0)))
