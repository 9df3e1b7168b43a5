"""Cleaning, schema checks and minimum-count filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisle import skew

# Required columns of the three input tables and the weight of each event type.
USER_COLUMNS = ("user_id", "user_age_bucket", "user_region")
ITEM_COLUMNS = (
    "item_id",
    "title",
    "category",
    "brand",
    "price",
    "avg_rating",
    "rating_count",
    "description",
)
INTERACTION_COLUMNS = ("user_id", "item_id", "timestamp", "event_type", "rating", "event_weight")
EVENT_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 4.0}
SPLITS = ("train", "val", "test")


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """Fail at plan time when a required column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _number(name: str, default: float) -> Column:
    value = F.col(name).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(default)))


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def clean_items(items: DataFrame, order: Sequence[str] = ITEM_COLUMNS[1:]) -> DataFrame:
    require_columns(items, ITEM_COLUMNS, "items")
    firsts = keep_first(items.where("item_id is not null"), ["item_id"], order)
    return firsts.select(
        "item_id",
        _text("title", "").alias("title"),
        _text("category", "Unknown").alias("category"),
        _text("brand", "Unknown").alias("brand"),
        F.round(_number("price", 0.0), 2).alias("price"),
        _number("avg_rating", 0.0).alias("avg_rating"),
        _number("rating_count", 0.0).cast("long").alias("rating_count"),
        _text("description", "").alias("description"),
    )


def clean_users(users: DataFrame, order: Sequence[str] = USER_COLUMNS[1:]) -> DataFrame:
    require_columns(users, USER_COLUMNS, "users")
    firsts = keep_first(users.where("user_id is not null"), ["user_id"], order)
    return firsts.select(
        "user_id",
        _text("user_age_bucket", "Unknown").alias("user_age_bucket"),
        _text("user_region", "Unknown").alias("user_region"),
    )


def event_weight(event_type: Column | str, given: Column | None = None) -> Column:
    """Weight of a known event type, else the given weight, else 1."""
    kind = F.col(event_type) if isinstance(event_type, str) else event_type
    known = F.when(F.lit(False), 0.0)
    for name, weight in EVENT_WEIGHTS.items():
        known = known.when(kind == name, weight)
    return F.coalesce(known, *([] if given is None else [given]), F.lit(1.0))


def clean_interactions(interactions: DataFrame) -> DataFrame:
    """Typed interactions without broken keys, unreadable times or exact duplicates."""
    require_columns(interactions, INTERACTION_COLUMNS, "interactions")
    extra = [c for c in interactions.columns if c not in INTERACTION_COLUMNS]
    if isinstance(interactions.schema["timestamp"].dataType, T.StringType):
        time = F.try_to_timestamp("timestamp").cast("timestamp_ntz")
    else:
        time = F.col("timestamp").cast("timestamp_ntz")
    given = F.col("event_weight").cast("string").try_cast("double")
    return (
        interactions.dropna(subset=["user_id", "item_id", "timestamp", "event_type"])
        .select(
            *extra,
            "user_id",
            "item_id",
            time.alias("timestamp"),
            F.col("event_type").cast("string").alias("event_type"),
            _number("rating", 0.0).alias("rating"),
            event_weight("event_type", given).alias("event_weight"),
        )
        .where("timestamp is not null")
        .dropDuplicates()
    )


def min_count_filter(
    users: DataFrame, items: DataFrame, interactions: DataFrame, min_user: int, min_item: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass of both minimums: users first, then items over the events that are left."""
    kept = interactions
    for key, least in (("user_id", min_user), ("item_id", min_item)):
        if least > 1:
            enough = kept.groupBy(key).count().where(F.col("count") >= least).select(key)
            kept = skew.join(kept, enough, key, "left_semi", keys_from=interactions)
    return (
        users.join(kept.select("user_id").distinct(), "user_id", "left_semi"),
        items.join(kept.select("item_id").distinct(), "item_id", "left_semi"),
        kept,
    )


def validate_query_pairs(pairs: DataFrame) -> DataFrame:
    """One row of violation counts; all zero means the pairs are valid."""
    required = (
        "query_id query_text target_item_id category intent source brand price_constraint "
        "use_case relevance_label split"
    ).split()
    require_columns(pairs, required, "query pairs")
    per_id = pairs.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("split").isin(*SPLITS)).alias("bad_split"),
        F.count_if(F.col("relevance_label") != 1).alias("bad_label"),
    )
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_pairs"),
        F.count_if(F.col("n") > 1).alias("duplicate_query_ids"),
        F.coalesce(F.sum("bad_split"), F.lit(0)).alias("invalid_splits"),
        F.coalesce(F.sum("bad_label"), F.lit(0)).alias("invalid_labels"),
    )


def check_query_pairs(pairs: DataFrame) -> DataFrame:
    """Raise when the pairs break a rule, else hand them back."""
    found = validate_query_pairs(pairs).first().asDict()
    broken = {k: v for k, v in found.items() if k != "num_pairs" and v}
    if broken:
        raise ValueError(f"query pairs are invalid: {broken}")
    return pairs


def validate_candidates(candidates: DataFrame) -> DataFrame:
    required = "query_id query_text split target_item_id candidate_item_id label".split()
    require_columns(candidates, required, "ranking candidates")
    per_pair = candidates.groupBy("query_id", "candidate_item_id").count()
    return per_pair.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("num_rows"),
        F.count_if(F.col("count") > 1).alias("duplicate_pairs"),
    )


def check_candidates(candidates: DataFrame) -> DataFrame:
    found = validate_candidates(candidates).first()
    if not found["num_rows"]:
        raise ValueError("ranking candidates are empty")
    if found["duplicate_pairs"]:
        raise ValueError("ranking candidates repeat an item within a query")
    return candidates


def filter_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def attach_split(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    parts = [part.withColumn("split", F.lit(s)) for part, s in zip((train, val, test), SPLITS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a fixed schema, adding absent columns as null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
