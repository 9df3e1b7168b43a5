"""Candidate-constrained generation as table jobs: contexts, prompts, model, parse, validate.

The model is a pluggable stage. By default it is a set of column rules that write the same kind of
JSON text a remote model would; ``batch_infer`` runs a user function over the prompts instead. What
follows, parsing, validation and fallback, is the same for both.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.jsonx import RANKED_ITEM_SCHEMA, RECOMMENDATION_SCHEMA, extract_json, is_json_object
from aisle.functions.text import estimated_cost, token_count, truncate_text
from aisle.operators.ranking import RANK_PRIORITY, SCORE_PRIORITY, top_candidates
from aisle.session import cut_lineage, keep_columns

STRINGS = "array<string>"
RANKED = "array<struct<item_id:string,rank:int,reason:string,confidence:double>>"

# Reasons and ids the default rules emit.
DIRECT_REASON = "Direct mock generation without catalog grounding."
CONSTRAINED_REASON = "Selected from provided candidate IDs."
RERANK_REASON = "Deterministically reranked from provided candidate IDs."
FALLBACK_REASON = "Fallback to original ranked candidate order."
INVALID_ITEM = "item_mock_invalid_001"


def format_candidates(top: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """One array of compact candidate structs per query, in candidate order.

    ``top`` holds at most a pool of rows per query; catalog values win over candidate values.
    Struct fields are in alphabetical order, so ``to_json`` writes sorted keys.
    """
    have = set(top.columns)
    score = next((c for c in SCORE_PRIORITY if c in have), None)
    rank = next((c for c in RANK_PRIORITY if c in have), None)
    texts = ("title", "category", "brand", "description")
    numbers = ("price", "avg_rating", "rating_count")
    catalog = items.select(
        F.col("item_id").alias("candidate_item_id"),
        *[F.col(c).alias(f"_{c}") for c in (*texts, *numbers)],
    )
    top = top.where(F.col("candidate_rank") <= limit)
    joined = skew.join_named(top, catalog, "candidate_item_id", "left", row_id=["query_id"])

    def value(name: str, default) -> Column:
        options = [F.col(f"_{name}")] + ([F.col(name)] if name in have else [])
        return F.coalesce(*options, F.lit(default))

    evidence = F.concat_ws(" ", *[value(c, "") for c in texts])
    fields = {
        "avg_rating": value("avg_rating", 0.0).cast("double"),
        "brand": value("brand", ""),
        "category": value("category", ""),
        "evidence_text": truncate_text(evidence),
        "item_id": F.col("candidate_item_id").cast("string"),
        "price": value("price", 0.0).cast("double"),
        "rank": F.lit(0) if rank is None else F.coalesce(F.col(rank), F.lit(0)).cast("int"),
        "rating_count": value("rating_count", 0).cast("long"),
        "score": F.lit(0.0) if score is None else F.coalesce(F.col(score), F.lit(0.0)).cast("double"),
        "title": value("title", ""),
    }
    entry = F.struct("candidate_rank", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("c"))
    return (
        joined.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select("query_id", F.col("e.c").alias("candidates"))
    )


def query_contexts(
    pairs: DataFrame,
    items: DataFrame,
    candidates: DataFrame,
    parsed: DataFrame | None = None,
    profiles: DataFrame | None = None,
    split: str | None = None,
    pool: int = 20,
    max_queries: int | None = None,
) -> DataFrame:
    """Queries with their candidate array, parsed query and, where pairs name a user, profile."""
    wanted = pairs if split is None else pairs.where(F.col("split") == split)
    if max_queries is not None:
        wanted = wanted.orderBy("split", "query_id").limit(max_queries)
    people = ["user_id"] if "user_id" in pairs.columns else []
    wanted = wanted.select("query_id", "query_text", "split", "target_item_id", *people)
    lists = format_candidates(top_candidates(candidates, pool), items, pool)
    out = wanted.join(lists, "query_id", "left")
    out = out.withColumn("candidates", F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)))
    empty = F.lit("{}")
    if parsed is not None:
        fields = {
            "brand": "parsed_brand",
            "category": "parsed_category",
            "expanded_queries": "expanded_queries",
            "intent": "parsed_intent",
            "price_constraint": "parsed_price_constraint",
            "rewritten_query": "rewritten_query",
            "use_case": "parsed_use_case",
        }
        payload = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
        out = out.join(parsed.select("query_id", payload.alias("parsed_query")), "query_id", "left")
        out = out.withColumn("parsed_query", F.coalesce("parsed_query", empty))
    else:
        out = out.withColumn("parsed_query", empty)
    if profiles is not None and people:
        names = ("price_preference", "profile_text", "summary", "top_brands", "top_categories", "user_id")
        payload = F.to_json(F.struct(*names))
        profile = profiles.select("user_id", payload.alias("user_profile"))
        out = skew.join(out, profile, "user_id", "left", keys_from=pairs, row_id=["query_id"])
        return out.withColumn("user_profile", F.coalesce("user_profile", empty))
    return out.withColumn("user_profile", empty)


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def candidate_ids(pool: int | None = None) -> Column:
    ids = F.array_distinct(F.transform("candidates", lambda c: c["item_id"]))
    return ids if pool is None else F.slice(ids, 1, pool)


def build_prompt(task: str, top_k: int = 10, pool: int | None = None) -> Column:
    """Prompt text of one context for direct, constrained or rerank generation."""
    shown = F.col("candidates") if pool is None else F.slice("candidates", 1, pool)
    head = [
        F.lit(f"TASK: {task}"),
        _labelled("Query", F.col("query_text")),
        F.lit(f"Top K: {top_k}"),
        _labelled("Parsed query JSON", F.col("parsed_query")),
        _labelled("User profile JSON", F.col("user_profile")),
    ]
    if task != "DIRECT_GENERATION":
        head.append(_labelled("Candidates JSON", F.to_json(F.struct(shown.alias("candidates")))))
        head.append(F.lit("Use candidate item ids only and keep to the facts shown."))
    head.append(F.lit("Answer as JSON with recommended_item_ids and ranked_items."))
    return _lines(*head)


def build_query_prompts(queries: DataFrame, items: DataFrame, max_expanded: int = 3) -> DataFrame:
    """``queries`` with a ``prompt`` that asks for the structure of ``query_text``.

    The known values are one text of the catalog, made once and the same in every prompt.
    """
    known = items.agg(
        *[
            F.coalesce(
                F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " | "), F.lit("")),
                F.lit("None"),
            ).alias(c)
            for c in ("category", "brand")
        ]
    )
    prompt = _lines(
        "TASK: QUERY_UNDERSTANDING",
        _labelled("Query", F.col("query_text")),
        _labelled("Known categories", known.select("category").scalar()),
        _labelled("Known brands", known.select("brand").scalar()),
        f"Max expanded queries: {max_expanded}",
        "Answer as JSON with intent, category, brand, constraints, rewritten_query, "
        "expanded_queries and confidence.",
    )
    return queries.withColumn("prompt", prompt)


def build_profile_prompt() -> Column:
    """Prompt text asking for a profile from a behaviour summary row."""
    fields = (
        "avg_price",
        "behavior_signals",
        "history_length",
        "price_preference",
        "recent_interests",
        "top_brands",
        "top_categories",
        "user_id",
    )
    return _lines(
        "TASK: USER_PROFILE",
        _labelled("Behavior summary", F.to_json(F.struct(*fields))),
        "Answer as JSON with summary, top_categories, top_brands, price_preference, profile_text "
        "and confidence, from this evidence only.",
    )


def build_explanation_prompt(recommended: Column, evidence: Column) -> Column:
    """Prompt text asking for explanations grounded in an evidence array."""
    return _lines(
        "TASK: EVIDENCE_GROUNDED_EXPLANATION",
        _labelled("Query", F.col("query_text")),
        _labelled("Recommended items JSON", F.to_json(F.struct(recommended.alias("recommended_items")))),
        _labelled("Evidence JSON", F.to_json(F.struct(evidence.alias("evidence")))),
        "Answer as JSON with query_id and explanations that cite the evidence item ids.",
    )


def batch_infer(
    prompts: DataFrame,
    model: Callable[[list[str]], list[str]],
    provider: str,
    model_name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Run a user function over the ``prompt`` column in Arrow batches.

    The function gets and returns lists of texts. Each row records latency, token counts and cost;
    ``partitions`` sets how many batches run at once.
    """
    placed = prompts if partitions is None else prompts.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            texts = model(batch["prompt"].tolist())
            spent = (time.perf_counter() - start) * 1000.0 / max(1, len(batch))
            yield batch.assign(output_text=texts, latency_ms=spent)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    answered = placed.mapInPandas(run, f"{schema}, output_text string, latency_ms double")
    return with_usage(answered, provider, model_name)


def with_usage(answered: DataFrame, provider: str, model_name: str) -> DataFrame:
    """Provider, model, token counts and cost next to prompt and output text."""
    out = answered.withColumns(
        {
            "provider": F.lit(provider),
            "model": F.lit(model_name),
            "prompt_tokens": token_count("prompt"),
            "completion_tokens": token_count("output_text"),
        }
    )
    cost = estimated_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("provider"))
    return out.withColumn("estimated_cost_usd", cost)


def _ranked(ids: Column, reason: str, confidence: float) -> Column:
    return F.transform(
        ids,
        lambda x, i: F.struct(
            x.alias("item_id"),
            (i + 1).cast("int").alias("rank"),
            F.lit(reason).alias("reason"),
            F.lit(confidence).alias("confidence"),
        ),
    )


def _answer(ids: Column, reason: str) -> Column:
    return F.to_json(
        F.struct(_ranked(ids, reason, 0.8).alias("ranked_items"), ids.alias("recommended_item_ids"))
    )


def direct_rule(top_k: int = 10) -> Column:
    """Numbered ids with one invalid id in second place."""
    ids = [f"item_{n:05d}" for n in range(1, top_k)]
    ids.insert(1, INVALID_ITEM)
    return _answer(F.array(*[F.lit(i) for i in ids[:top_k]]), DIRECT_REASON)


def constrained_rule(top_k: int = 10) -> Column:
    """The first candidates in their own order."""
    return _answer(F.slice(candidate_ids(), 1, top_k), CONSTRAINED_REASON)


def rerank_rule(top_k: int = 10, pool: int = 20) -> Column:
    """The pool's ids sorted downwards."""
    ids = F.slice(F.sort_array(candidate_ids(pool), asc=False), 1, top_k)
    return _answer(ids, RERANK_REASON)


def parse_recommendations(answered: DataFrame, text: str = "output_text", top_k: int = 10) -> DataFrame:
    """Ids, ranked items and flags of each output text.

    Ids listed first come first, then those of the ranked items; blanks and repeats are dropped
    and at most ``top_k`` stay. A list field of another type counts as empty, and so does an entry of
    the ranked items that is no object.
    """
    body = extract_json(text)
    parsed = answered.withColumn("_body", body).withColumn(
        "_o", F.from_json("_body", RECOMMENDATION_SCHEMA)
    )
    ok = is_json_object(F.col("_body"))
    none = F.array().cast(STRINGS)
    listed = F.coalesce("_o.recommended_item_ids", none)
    entries = F.filter(F.coalesce("_o.ranked_items", none), lambda e: e.startswith("{"))
    read = F.transform(entries, lambda e: F.from_json(e, RANKED_ITEM_SCHEMA))
    ranked = F.filter(read, lambda r: r["item_id"].isNotNull())

    def cleaned(values: Column) -> Column:
        trimmed = F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.trim(x))
        return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x != "")), 1, top_k)

    # ids listed first fill most lists; then no entry of the ranked items is read for them
    parsed = parsed.withColumn("_listed", cleaned(listed))
    ids = F.when(F.size("_listed") >= top_k, F.col("_listed")).otherwise(
        cleaned(F.concat(listed, F.transform(ranked, lambda r: r["item_id"])))
    )
    parsed = parsed.withColumns(
        {
            "parse_success": ok,
            "_ranked": F.when(ok, ranked).otherwise(F.array().cast(RANKED)),
            "recommended_item_ids": F.when(ok, ids).otherwise(none),
        }
    )
    return (
        _attach_ranked(parsed)
        .withColumns(
            {
                "schema_valid": F.col("parse_success"),
                "invalid_item_ids": none,
                "used_fallback": F.lit(False),
                "parse_error": F.when(~F.col("parse_success"), "output is not a JSON object"),
            }
        )
        .drop("_body", "_o", "_listed", "_ranked")
    )


def _attach_ranked(df: DataFrame) -> DataFrame:
    """Rank from 1 in id order, with the last reason and confidence given for an id."""

    def entry(item: Column, place: Column) -> Column:
        last = F.get(F.filter("_ranked", lambda r: r["item_id"] == item), _last_place(item))
        return F.struct(
            item.alias("item_id"),
            (place + 1).cast("int").alias("rank"),
            F.coalesce(last["reason"], F.lit("")).alias("reason"),
            F.coalesce(last["confidence"], F.lit(0.0)).alias("confidence"),
        )

    def _last_place(item: Column) -> Column:
        return F.size(F.filter("_ranked", lambda r: r["item_id"] == item)) - 1

    return df.withColumn("ranked_items", F.transform("recommended_item_ids", entry))


def validate_ids(parsed: DataFrame, allowed: Column) -> DataFrame:
    """Split ids into allowed and invalid ones; any invalid id makes the row's schema invalid."""
    known = F.coalesce(allowed, F.array().cast(STRINGS))
    checked = parsed.withColumn("_allowed", known)
    bad = F.filter("recommended_item_ids", lambda x: ~F.array_contains("_allowed", x))
    good = F.filter("recommended_item_ids", lambda x: F.array_contains("_allowed", x))
    return (
        checked.withColumn("invalid_item_ids", bad)
        .withColumn("_ranked", F.col("ranked_items"))
        .withColumn("recommended_item_ids", good)
        .withColumn("schema_valid", F.col("schema_valid") & (F.size("invalid_item_ids") == 0))
        .transform(_attach_ranked)
        .drop("_allowed", "_ranked")
    )


def check_catalog_ids(outputs: DataFrame, catalog: DataFrame, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Valid and invalid id counts of each list against the whole catalog, joined as rows."""
    # answers are read once: rows made of their ids, and what is joined with them, would read them anew
    outputs = keep_columns(outputs.select(*key, "recommended_item_ids"), "outputs")
    emitted = outputs.select(*key, F.explode("recommended_item_ids").alias("id"))
    known = catalog.select(F.col("item_id").cast("string").alias("id"), F.lit(True).alias("_in"))
    marked = skew.join_named(emitted, known, "id", "left", row_id=list(key))
    counted = marked.groupBy(*key).agg(
        F.count("_in").alias("valid_item_count"),
        F.count_if(F.col("_in").isNull()).alias("invalid_item_count"),
    )
    joined = outputs.select(*key).join(counted, list(key), "left").na.fill(0)
    total = F.col("valid_item_count") + F.col("invalid_item_count")
    return joined.withColumns(
        {
            "valid_item_rate": F.when(total > 0, F.col("valid_item_count") / total).otherwise(0.0),
            "hallucination_rate": F.when(total > 0, F.col("invalid_item_count") / total).otherwise(0.0),
        }
    )


def fallback_to_candidates(validated: DataFrame, top_k: int = 10, pool: int | None = None) -> DataFrame:
    """Rows that failed parsing or validation get the original candidate order, confidence 0.

    Their parse and schema flags and invalid ids stay visible.
    """
    failed = ~F.col("parse_success") | ~F.col("schema_valid") | (F.size("invalid_item_ids") > 0)
    ids = F.slice(candidate_ids(pool), 1, top_k)
    return validated.withColumn("_failed", failed).withColumns(
        {
            "recommended_item_ids": F.when(F.col("_failed"), ids).otherwise(F.col("recommended_item_ids")),
            "ranked_items": F.when(F.col("_failed"), _ranked(ids, FALLBACK_REASON, 0.0)).otherwise(
                F.col("ranked_items")
            ),
            "used_fallback": F.col("_failed") | F.col("used_fallback"),
        }
    ).drop("_failed")


def _generate(
    contexts: DataFrame,
    method: str,
    task: str,
    rule: Column,
    top_k: int,
    pool: int | None,
    model: Callable[[list[str]], list[str]] | None,
    provider: str,
    model_name: str,
    constrained: bool,
) -> DataFrame:
    prompts = contexts.withColumn("prompt", build_prompt(task, top_k, pool))
    if model is None:
        answered = with_usage(
            prompts.withColumns({"output_text": rule, "latency_ms": F.lit(0.0)}), provider, model_name
        )
    else:
        # stored at once, so that later steps do not call the model again
        answered = cut_lineage(batch_infer(prompts, model, provider, model_name))
    parsed = parse_recommendations(answered, top_k=top_k)
    if constrained:
        parsed = fallback_to_candidates(validate_ids(parsed, candidate_ids(pool)), top_k, pool)
        size = F.size("candidates") if pool is None else F.least(F.size("candidates"), F.lit(pool))
    else:
        size = F.lit(0)
    return parsed.select(
        "query_id",
        "query_text",
        "split",
        "target_item_id",
        F.lit(method).alias("method"),
        "provider",
        "model",
        "recommended_item_ids",
        "ranked_items",
        "parse_success",
        "schema_valid",
        "invalid_item_ids",
        "used_fallback",
        "parse_error",
        "latency_ms",
        "estimated_cost_usd",
        size.alias("candidate_pool_size"),
    )


def direct_generation(
    contexts: DataFrame, top_k: int = 10, model=None, provider: str = "mock", model_name: str = "rules"
) -> DataFrame:
    """Unconstrained baseline: parsed only, never checked against the candidates."""
    return _generate(contexts, "direct_generation", "DIRECT_GENERATION", direct_rule(top_k), top_k,
                     None, model, provider, model_name, False)


def constrained_generation(
    contexts: DataFrame, top_k: int = 10, model=None, provider: str = "mock", model_name: str = "rules"
) -> DataFrame:
    """Ids restricted to the candidates, with fallback to their original order."""
    return _generate(contexts, "candidate_constrained_generation", "CANDIDATE_CONSTRAINED_GENERATION",
                     constrained_rule(top_k), top_k, None, model, provider, model_name, True)


def rerank_generation(
    contexts: DataFrame, pool: int = 20, top_k: int = 10, model=None, provider: str = "mock",
    model_name: str = "rules",
) -> DataFrame:
    """Re-ordering of the first ``pool`` candidates, with the same checks and fallback."""
    return _generate(contexts, f"llm_rerank_top_{pool}", "RERANK", rerank_rule(top_k, pool), top_k,
                     pool, model, provider, model_name, True)


def run_experiments(
    contexts: DataFrame, names: tuple[str, ...], top_k: int = 10, model=None, provider: str = "mock"
) -> DataFrame:
    """Outputs of the named experiments in one frame."""
    out = None
    for name in names:
        if name == "direct_generation":
            part = direct_generation(contexts, top_k, model, provider)
        elif name == "candidate_constrained_generation":
            part = constrained_generation(contexts, top_k, model, provider)
        elif name.startswith("llm_rerank_top_"):
            part = rerank_generation(contexts, int(name.rsplit("_", 1)[-1]), top_k, model, provider)
        else:
            raise ValueError(f"unknown experiment: {name}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no experiment named")
    return out
