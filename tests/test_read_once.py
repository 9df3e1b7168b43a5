"""Answers are read once, and rows made of a small file are spread over tasks."""

from pyspark.sql import functions as F

from aisle.operators import generation, metrics
from aisle.sources import testdata


def _outputs(spark, reads):
    @F.udf("array<string>")
    def ids(n):
        reads.add(1)
        return [str(n % 5), "nowhere"] if n % 4 else []

    none = F.array().cast("array<string>")
    return spark.range(0, 40, 1, 4).select(
        F.concat(F.lit("q"), "id").alias("query_id"), F.lit("m").alias("method"), F.lit("p").alias("provider"),
        F.lit("r").alias("model"), F.lit("test").alias("split"), ids("id").alias("recommended_item_ids"),
        none.alias("invalid_item_ids"), F.lit(True).alias("parse_success"), F.lit(True).alias("schema_valid"),
        F.lit(False).alias("used_fallback"), F.lit(0.0).alias("estimated_cost_usd"),
    )


def test_catalog_check_reads_each_answer_once(spark):
    reads = spark.sparkContext.accumulator(0)
    catalog = spark.range(0, 3).select(F.col("id").alias("item_id"))
    rows = generation.check_catalog_ids(_outputs(spark, reads), catalog).collect()
    assert reads.value == 40 and len(rows) == 40
    assert sum(r["valid_item_count"] for r in rows) == sum(1 for n in range(40) if n % 4 and n % 5 < 3)
    assert sum(r["invalid_item_count"] for r in rows) == sum(1 + (n % 5 >= 3) for n in range(40) if n % 4)


def test_generation_metrics_read_each_answer_once(spark):
    reads = spark.sparkContext.accumulator(0)
    catalog = spark.range(0, 3).select(F.col("id").alias("item_id"))
    pairs = spark.range(0, 40).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.col("id") % 5).alias("target_item_id"))
    rows = metrics.genrec_per_query(_outputs(spark, reads), pairs, catalog).collect()
    assert reads.value == 40 and len(rows) == 40
    assert sum(r["recall_at_10"] for r in rows) == 30
    assert {r["valid_item_rate"] for r in rows if r["query_id"] == "q1"} == {0.5}


def test_items_of_a_small_file_are_spread(spark, tmp_path):
    from checks.base import Inputs

    spark.range(0, 300, 1, 1).selectExpr(
        "id as p_partkey", "concat('red ring ', id) as p_name", "'Brand#3' as p_brand", "'PROMO' as p_type",
        "int(id % 9) as p_size",
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 600, 1, 1).selectExpr("id % 250 as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = Inputs(spark, str(tmp_path)).items
    parts = found.rdd.glom().map(len).collect()
    assert sum(1 for n in parts if n) > 1 and sum(parts) == 300
    plain = testdata.items(spark, str(tmp_path))
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    found.unpersist()


def test_candidate_lists_are_not_sent_to_all_tasks(spark):
    from aisle.operators import ranking

    catalog = spark.range(0, 60).select(F.col("id").alias("item_id"))
    pairs = spark.range(0, 30).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.col("id") * 2).alias("target_item_id"))
    ranked = pairs.select("query_id", F.posexplode(F.sequence(F.lit(5), F.lit(14))).alias("p", "i"))
    ranked = ranked.select("query_id", F.col("i").cast("long").alias("item_id"), (F.col("p") + 1).alias("rank"))
    out = ranking.candidate_pool(pairs, catalog, ranked, ranked, ranked, pool=12, random_negatives=3)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sides if "LeftAnti" in line or "query_id" in line.partition("],")[0]], sides
    sizes = {r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 30 and set(sizes.values()) == {12}
    assert out.groupBy("query_id", "candidate_item_id").count().where("count > 1").isEmpty()
    forced = out.where("candidate_source like '%positive_forced'")
    assert forced.count() == sum(1 for n in range(30) if not 5 <= 2 * n <= 14)


def test_evidence_reads_each_answer_once(spark):
    from aisle.operators import explanations

    reads = spark.sparkContext.accumulator(0)
    items = spark.range(0, 5).selectExpr(
        "id as item_id", "concat('t', id) as title", "'c' as category", "'b' as brand", "1.0D as price",
        "4.0D as avg_rating", "id as rating_count",
    )
    frame = spark.range(0, 40).selectExpr(
        "concat('q', id) as query_id", "id % 5 as candidate_item_id", "0.5D as hybrid_score", "'c' as category"
    )
    found = explanations.select_evidence(_outputs(spark, reads), items, frame, 1).collect()
    assert reads.value == 40 and len(found) == 30
    assert all(r["retrieval_score"] == 0.5 and r["title"] == f"t{r['item_id']}" for r in found)


def test_objects_are_told_without_the_schema_of_their_values(spark):
    from aisle.functions.jsonx import is_json_object

    texts = {
        '{"a": [1, {"b": 2}]}': True, ' \n\t{} ': True, "[1]": False, '"{}"': False, "{": False, "null": False,
        "{'a': 1}": False, '{"a": 1,}': False, "": False, "12 {": False,
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_json_object(F.col("t")).alias("is"))
    assert "schemaOfVariant" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert {r["t"]: r["is"] for r in frame.collect()} == texts
    assert spark.sql("select cast(null as string) as t").select(is_json_object(F.col("t"))).first()[0] is False


def test_full_lists_stand_without_the_ranked_items(spark):
    ids = ", ".join(f'"{n}"' for n in range(11))
    short = '{"recommended_item_ids": [" 1 ", "", "1", null], "ranked_items": [{"item_id": "z"}, 5, {"item_id": "y"}]}'
    full = f'{{"recommended_item_ids": [{ids}], "ranked_items": [{{"item_id": "3", "reason": "why"}}, {{"item_id": "z"}}]}}'
    out = generation.parse_recommendations(spark.createDataFrame([("f", full), ("s", short)], "q string, output_text string"))
    found = {r["q"]: r for r in out.collect()}
    assert found["f"]["recommended_item_ids"] == [str(n) for n in range(10)]
    assert [r["reason"] for r in found["f"]["ranked_items"] if r["item_id"] == "3"] == ["why"]
    assert found["s"]["recommended_item_ids"] == ["1", "z", "y"]
