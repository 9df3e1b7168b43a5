"""Adapters from the driver's test tables to items, users, interactions and query pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category per part type and the eight catalog brands.
CATEGORY_BY_TYPE = {
    "ECONOMY": "Sports & Outdoors",
    "SMALL": "Beauty",
    "MEDIUM": "Electronics",
    "PROMO": "Clothing",
    "STANDARD": "Health & Personal Care",
}
BRANDS = ("Nova", "Orbit", "Luma", "Stride", "Haven", "Pulse", "Aster", "Kindlewood")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.count("*").alias("n"))
    )
    kind = F.substring_index("p_type", " ", 1)
    category = F.lit("Electronics")
    for name, label in CATEGORY_BY_TYPE.items():
        category = F.when(kind == name, label).otherwise(category)
    brand_no = F.substring("p_brand", 7, 10).cast("int") % len(BRANDS)
    return part.join(counts, "p_partkey", "left").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        category.alias("category"),
        F.element_at(F.array(*[F.lit(b) for b in BRANDS]), brand_no + 1).alias("brand"),
        F.round(8 + F.col("p_size") * F.lit(4.24), 2).alias("price"),
        F.round(3.2 + ((F.col("p_partkey") * 37) % 181) / F.lit(100.0), 2).alias("avg_rating"),
        F.coalesce("n", F.lit(0)).cast("long").alias("rating_count"),
        F.concat_ws(
            " ", F.lower("p_type"), "p_name", F.lit("size"), F.col("p_size").cast("string")
        ).alias("description"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type") == "signup", "add_to_cart").otherwise(F.col("event_type"))
    weight = (
        F.when(event == "view", 1.0)
        .when(event == "click", 2.0)
        .when(event == "add_to_cart", 3.0)
        .when(event == "purchase", 4.0)
    )
    return (
        table(spark, sf_dir, "events")
        .where("event_type <> 'error'")
        .select(
            "event_id",
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            F.col("ts").cast("timestamp_ntz").alias("timestamp"),
            event.alias("event_type"),
            (weight + 1).alias("rating"),
            weight.alias("event_weight"),
        )
    )


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, larger user-item graph: customers buying parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
        F.lit("purchase").alias("event_type"),
        F.lit(5.0).alias("rating"),
        F.lit(4.0).alias("event_weight"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_mktsegment").alias("user_age_bucket"),
            F.col("r_name").alias("user_region"),
        )
    )


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("description")
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )
