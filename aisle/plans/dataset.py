"""Dataset build: clean, filter, split, sequences and negatives written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from aisle.operators import clean, splits
from aisle.sources.files import scan_parquet, sink_parquet


def build_dataset(
    users: DataFrame,
    items: DataFrame,
    interactions: DataFrame,
    root: str,
    min_user: int = 1,
    min_item: int = 1,
    val_last_n: int = 1,
    test_last_n: int = 1,
    negatives: int = 5,
    seed: int = 42,
    row_key: str = "event_id",
) -> dict[str, DataFrame]:
    """Write users, items, split interactions, sequences and negatives; return them as read back.

    The split is written once, partitioned by ``split``, and everything later reads that table.
    """
    spark = interactions.sparkSession
    cleaned = clean.clean_interactions(interactions)
    kept_users, kept_items, kept = clean.min_count_filter(
        clean.clean_users(users), clean.clean_items(items), cleaned, min_user, min_item
    )
    labelled = splits.leave_one_out(kept, row_key, val_last_n, test_last_n)
    sink_parquet(labelled, f"{root}/interactions", ["split"])
    split = scan_parquet(spark, f"{root}/interactions")
    sink_parquet(kept_users.join(split.select("user_id").distinct(), "user_id", "left_semi"), f"{root}/users")
    sink_parquet(kept_items.join(split.select("item_id").distinct(), "item_id", "left_semi"), f"{root}/items")
    catalog = scan_parquet(spark, f"{root}/items")
    sink_parquet(splits.user_sequences(split), f"{root}/user_sequences")
    sink_parquet(
        splits.negative_sampling(split, catalog, negatives, seed), f"{root}/negative_samples", ["split"]
    )
    out = {name: scan_parquet(spark, f"{root}/{name}") for name in ("users", "items")}
    for name in clean.SPLITS:
        out[name] = split.where(f"split = '{name}'")
    for name in ("user_sequences", "negative_samples"):
        out[name] = scan_parquet(spark, f"{root}/{name}")
    return out
