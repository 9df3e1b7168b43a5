"""Helpers of the training-data operators: shared tables, orders over all rows, joins by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.session import scratch_dir

#: A side with at most this many rows of a few numbers may be sent to every executor.
BROADCAST_ROWS = 500_000

#: White space and words as the contracts of this subpackage define them.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``_part`` and ``_at``: ascending parts of the order, and the place inside the part.

    The rows are cut into ranges of the whole ``order``, so a hot value of its first column is
    spread as long as later columns differ. The result is stored, places do not change any more.
    """
    spread = df.repartitionByRange(shuffle_parts(df), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(spread.withColumns({"_part": F.spark_partition_id(), "_at": at}), name)


def before_parts(totals: DataFrame) -> DataFrame:
    """Running total before each ``_part``; one row per partition of a job, so a small table."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )


def ranked(df: DataFrame, order: Sequence[str], name: str, rank: str = "rank") -> DataFrame:
    """Numbers all rows from 0 in ``order`` without bringing them into one task."""
    placed = in_order(df, order, name)
    starts = before_parts(placed.groupBy("_part").agg(F.count("*").alias("_total")))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(rank, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_part", "_at", "_before")
    )


def running(df: DataFrame, order: Sequence[str], amount: str, name: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all rows that come earlier in ``order``."""
    placed = in_order(df, order, name)
    starts = before_parts(placed.groupBy("_part").agg(F.sum(amount).alias("_total")))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_part", "_at", "_before", "_inside")
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counting stops one past the limit."""
    return df.limit(rows + 1).count() <= rows


def by_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small, else for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df
