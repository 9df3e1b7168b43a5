"""The popularity aggregates of the batch operators kept up to date from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_item_popularity(
    events: DataFrame, window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Per item and tumbling window the counts of ``item_popularity``.

    ``events`` is a streaming or batch frame of interactions with a ``timestamp`` column. Rows later
    than the watermark are dropped by the stream, which also bounds its state.
    """
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", window), "item_id")
        .agg(
            F.count("*").alias("item_popularity_count"),
            F.sum("event_weight").alias("item_event_weight_sum"),
            F.count_if(F.col("event_type") == "purchase").alias("item_purchase_count"),
            F.count_if(F.col("event_type") == "add_to_cart").alias("item_add_to_cart_count"),
        )
    )


def combine_windows(windowed: DataFrame) -> DataFrame:
    """Totals per item over all windows: the batch result."""
    names = [c for c in windowed.columns if c not in ("window", "item_id")]
    return windowed.groupBy("item_id").agg(*[F.sum(c).alias(c) for c in names])
