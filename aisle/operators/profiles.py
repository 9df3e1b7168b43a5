"""Behaviour summaries, profile texts and profile vectors per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions import jsonx
from aisle.functions.jsonx import extract_json
from aisle.functions.scores import price_preference
from aisle.functions.text import tokenize
from aisle.operators.recommend import top_values

EVENT_TYPES = ("purchase", "add_to_cart", "click", "view")


def behavior_summary(
    train: DataFrame, items: DataFrame, min_history: int = 1, recent: int = 5
) -> DataFrame:
    """One row per user with enough history.

    Events are added up per (user, item) before they meet the catalog, so a busy user or item
    costs one row per distinct pair. Recent titles come from a per-user top list.
    """
    weight = F.coalesce(F.col("event_weight").cast("double"), F.lit(1.0))
    per_pair = train.where("user_id is not null").groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"),
        F.sum(weight).alias("w"),
        F.collect_set("event_type").alias("events"),
        *[F.count_if(F.col("event_type") == e).alias(f"{e}_count") for e in EVENT_TYPES],
    )
    details = items.select("item_id", "title", "category", "brand", "price")
    rows = skew.join(
        per_pair, details, "item_id", "left", keys_from=train, row_id=["user_id"]
    )
    totals = rows.groupBy("user_id").agg(
        F.sum("n").alias("history_length"),
        (
            F.sum(F.col("n") * F.col("price")) / F.sum(F.when(F.col("price").isNotNull(), F.col("n")))
        ).alias("avg_price"),
        *[F.sum(f"{e}_count").alias(f"{e}_count") for e in EVENT_TYPES],
    )
    signals = (
        per_pair.select("user_id", F.explode("events").alias("e"))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("e")).alias("behavior_signals"))
    )
    tie = [F.col("event_id").desc()] if "event_id" in train.columns else [F.col("item_id").desc()]
    latest = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), *tie)
    titled = skew.join(
        train, items.where("title is not null").select("item_id", "title"), "item_id",
        keys_from=train,
    )
    recents = (
        titled.withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= recent)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), "title"))).alias("t"))
        .select("user_id", F.col("t.title").alias("recent_interests"))
    )
    out = totals.where(F.col("history_length") >= min_history)
    for part in (
        top_values(rows, "category", F.col("w"), 3, "top_categories"),
        top_values(rows, "brand", F.col("w"), 3, "top_brands"),
        recents,
        signals,
    ):
        out = out.join(part, "user_id", "left")
    none = F.array().cast("array<string>")
    lists = ("top_categories", "top_brands", "recent_interests", "behavior_signals")
    return out.withColumns({c: F.coalesce(c, none) for c in lists}).withColumn(
        "price_preference", price_preference("avg_price")
    )


def _first_two(column: str, otherwise: str):
    joined = F.array_join(F.slice(column, 1, 2), ", ")
    return F.when(F.size(column) > 0, joined).otherwise(otherwise)


def user_profile(summary: DataFrame, model_failed: bool = False) -> DataFrame:
    """Profile text and fields; with ``model_failed`` the fallback wording and confidence 0."""
    categories = _first_two("top_categories", "observed products")
    brands = _first_two("top_brands", "observed brands")
    # fixed sentences
    text = F.concat(
        F.lit("Interests: "), categories, F.lit(". Brands: "), brands,
        F.lit(". Price preference: "), "price_preference", F.lit("."),
    )
    if model_failed:
        sentence = F.lit("Profile based only on observed synthetic product interactions.")
    else:
        sentence = F.concat(
            F.lit("User shows interest in "), categories,
            F.lit(", based only on observed synthetic product interactions."),
        )
    return summary.withColumns(
        {
            "summary": sentence,
            "profile_text": text,
            "confidence": F.lit(0.0 if model_failed else 0.85),
            "parse_success": F.lit(not model_failed),
            "schema_valid": F.lit(not model_failed),
            "provider": F.lit("mock"),
            "estimated_cost_usd": F.lit(0.0),
        }
    )


# The fields that a model may write.
PROFILE_TEXTS = ("user_id", "summary", "price_preference", "profile_text")
PROFILE_LISTS = ("top_categories", "top_brands", "behavior_signals", "recent_interests")


def read_profiles(summary: DataFrame, answered: DataFrame, text: str = "output_text") -> DataFrame:
    """Profiles as a model wrote them over those that the summary alone gives.

    ``answered`` (user_id, text) has at most one output per user. A text field counts when it is not
    blank, a list field when it is a list; blank entries go. Confidence is 0 where it is missing, no
    number, or the output is no object; users without an output keep the fallback.
    """
    own = F.try_parse_json(extract_json(text))
    outputs = answered.select(
        "user_id",
        own.alias("_o"),
        *[c for c in ("provider", "model", "latency_ms", "estimated_cost_usd") if c in answered.columns],
    )
    given = [c for c in outputs.columns if c not in ("user_id", "_o")]
    fallback = user_profile(summary, model_failed=True).drop(*given)
    rows = fallback.join(outputs, "user_id", "left").withColumn("_valid", jsonx.is_object(F.col("_o")))
    fields = {}
    for name in PROFILE_TEXTS:
        kind = fallback.schema[name].dataType.simpleString()
        written = F.nullif(F.trim(jsonx.text_of(jsonx.member("_o", name))), F.lit(""))
        fields[name] = F.coalesce(F.when(F.col("_valid"), written.try_cast(kind)), F.col(name))
    for name in PROFILE_LISTS:
        value = jsonx.member("_o", name)
        written = F.filter(
            F.transform(
                F.try_variant_get(value, "$", "array<variant>"),
                lambda x: F.coalesce(jsonx.text_of(x), F.lit("None")),
            ),
            lambda t: F.trim(t) != "",
        )
        is_list = F.col("_valid") & F.schema_of_variant(value).startswith("ARRAY")
        fields[name] = F.when(is_list, written).otherwise(F.col(name))
    number = jsonx.number_of(jsonx.member("_o", "confidence"))
    fields["confidence"] = F.when(F.col("_valid"), F.coalesce(number, F.lit(0.0))).otherwise(F.lit(0.0))
    fields["parse_success"] = F.col("_valid")
    fields["schema_valid"] = F.col("_valid")
    fields["parse_error"] = F.when(F.col("_o").isNull(), "output is not JSON").when(
        ~F.col("_valid"), "output is not a JSON object"
    )
    return rows.withColumns(fields).drop("_o", "_valid")


def profile_vectors(profiles: DataFrame, max_features: int = 512, normalize: bool = True) -> DataFrame:
    """(user_id, term, weight): token counts over the most widespread terms, unit length."""
    counts = (
        profiles.select("user_id", F.explode(tokenize("profile_text")).alias("term"))
        .groupBy("user_id", "term")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    vocabulary = (
        counts.groupBy("term")
        .agg(F.count("*").alias("df"))
        .orderBy(F.col("df").desc(), "term")
        .limit(max_features)
        .select("term")
    )
    kept = counts.join(F.broadcast(vocabulary), "term")
    if normalize:
        per_user = Window.partitionBy("user_id")
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(per_user))
        kept = kept.withColumn("weight", F.col("weight") / norm)
    return kept.select("user_id", "term", "weight")
