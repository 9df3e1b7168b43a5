"""Evidence, explanations and their faithfulness, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.jsonx import EXPLANATION_SCHEMA, extract_json, is_json_object
from aisle.functions.text import truncate_text
from aisle.operators.ranking import SCORE_PRIORITY
from aisle.session import keep_columns

# Evidence fields an explanation cites.
EVIDENCE_FIELDS = ("title", "category", "brand", "avg_rating")


def select_evidence(
    recommendations: DataFrame,
    items: DataFrame,
    candidates: DataFrame | None = None,
    max_items: int = 5,
) -> DataFrame:
    """Evidence rows (query_id, place, item_id, ...) of the first recommended items.

    Catalog values win over candidate values; the score is the first one present in the candidate.
    """
    # answers are read once: they meet the catalog and the candidates
    recommendations = keep_columns(
        recommendations.select("query_id", F.slice("recommended_item_ids", 1, max_items).alias("_listed")),
        "recommended",
    )
    listed = recommendations.select("query_id", F.posexplode("_listed").alias("place", "item_id"))
    names = ("title", "category", "brand", "price", "avg_rating", "rating_count")
    catalog = items.select(
        F.col("item_id").cast("string").alias("item_id"), *[F.col(n).alias(f"_{n}") for n in names]
    )
    rows = skew.join_named(listed, catalog, "item_id", "left", row_id=["query_id"])
    own = set()
    if candidates is not None:
        own = {c for c in ("category", "brand", "price", "avg_rating", "rating_count") if c in candidates.columns}
        scores = [c for c in SCORE_PRIORITY if c in candidates.columns]
        score = F.coalesce(*[F.col(c) for c in scores], F.lit(0.0)) if scores else F.lit(0.0)
        extra = candidates.select(
            "query_id",
            F.col("candidate_item_id").cast("string").alias("item_id"),
            score.alias("retrieval_score"),
            *[F.col(c).alias(f"own_{c}") for c in sorted(own)],
        )
        # a query's candidates stay where they are; only those recommended go on
        asked = recommendations.withColumnRenamed("query_id", "_asking").hint("merge")
        wanted = (F.col("query_id") == F.col("_asking")) & F.array_contains("_listed", F.col("item_id"))
        extra = extra.join(asked, wanted, "left_semi")
        rows = rows.join(extra, ["query_id", "item_id"], "left")
        rows = rows.withColumn("retrieval_score", F.coalesce("retrieval_score", F.lit(0.0)))
    else:
        rows = rows.withColumn("retrieval_score", F.lit(0.0))

    def value(name: str, default) -> Column:
        options = [F.col(f"_{name}")] + ([F.col(f"own_{name}")] if name in own else [])
        return F.coalesce(*options, F.lit(default))

    shown = rows.select(
        "query_id",
        "place",
        "item_id",
        *[value(n, "").alias(n) for n in ("title", "category", "brand")],
        *[value(n, 0.0).cast("double").alias(n) for n in ("price", "avg_rating")],
        value("rating_count", 0).cast("long").alias("rating_count"),
        "retrieval_score",
    )
    text = F.format_string("%s %s %s rating %.2f price %.2f", "title", "category", "brand", "avg_rating", "price")
    return shown.withColumn("evidence_text", truncate_text(text))


def _explanations(evidence: DataFrame, text: Column, confidence: float) -> DataFrame:
    entry = F.struct(
        "place",
        F.struct(
            "item_id",
            text.alias("explanation"),
            F.array("item_id").alias("evidence_item_ids"),
            F.array(*[F.lit(f) for f in EVIDENCE_FIELDS]).alias("evidence_fields"),
            F.lit(confidence).alias("confidence"),
        ).alias("x"),
    )
    return (
        evidence.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select("query_id", F.col("e.x").alias("explanations"))
    )


def template_text() -> Column:
    """Template sentence; its format is a fixed value."""
    return F.format_string(
        "%s matches because it is a %s item from %s with rating %.2f.", "title", "category", "brand", "avg_rating"
    )


def grounded_text() -> Column:
    """Sentence of the default rule model; its format is a fixed value."""
    return F.format_string(
        "%s matches the query using catalog evidence from %s and %s.", "title", "category", "brand"
    )


def evidence_arrays(evidence: DataFrame) -> DataFrame:
    """At most a handful of evidence structs per query."""
    entry = F.struct("place", F.struct("item_id", "category", "brand").alias("x"))
    return (
        evidence.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select("query_id", F.col("e.x").alias("evidence"))
    )


def faithfulness(explained: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of explanations that miss evidence or name another evidence item's values.

    ``explained`` has an ``explanations`` array per query.
    """
    joined = explained.join(evidence_arrays(evidence), "query_id", "left")
    nothing = F.array().cast("array<struct<item_id:string,category:string,brand:string>>")
    joined = joined.withColumn("evidence", F.coalesce("evidence", nothing)).withColumn(
        "_ids", F.transform("evidence", lambda e: e["item_id"])
    )

    def missing(x: Column) -> Column:
        cited = F.coalesce(x["evidence_item_ids"], F.array().cast("array<string>"))
        return ~F.array_contains("_ids", x["item_id"]) | F.exists(
            cited, lambda i: ~F.array_contains("_ids", i)
        )

    def claims_other(x: Column) -> Column:
        said = F.lower(x["explanation"])
        own = F.filter("evidence", lambda e: e["item_id"] == x["item_id"])

        def foreign(field: str) -> Column:
            mine = F.coalesce(F.get(own, F.lit(0))[field], F.lit(""))
            return F.exists(
                "evidence",
                lambda e: (e[field] != "") & (e[field] != mine) & F.contains(said, F.lower(e[field])),
            )

        return foreign("category") | foreign("brand")

    counted = joined.withColumns(
        {
            "missing_evidence_count": F.size(F.filter("explanations", missing)),
            "ungrounded_claim_count": F.size(F.filter("explanations", claims_other)),
        }
    )
    faithful = (F.col("missing_evidence_count") == 0) & (F.col("ungrounded_claim_count") == 0)
    return counted.withColumn("explanation_faithful", faithful).drop("evidence", "_ids")


def template_explanations(evidence: DataFrame) -> DataFrame:
    explained = _explanations(evidence, template_text(), 0.75)
    return faithfulness(explained, evidence).withColumns(
        {
            "method": F.lit("template_explanation"),
            "provider": F.lit("template"),
            "model": F.lit("template"),
            "parse_success": F.lit(True),
            "schema_valid": F.lit(True),
            "used_fallback": F.lit(False),
            "estimated_cost_usd": F.lit(0.0),
        }
    )


def rule_explanation_text(evidence: DataFrame) -> DataFrame:
    """(query_id, output_text): JSON the default rule model answers with."""
    explained = _explanations(evidence, grounded_text(), 0.82)
    return explained.select(
        "query_id", F.to_json(F.struct("explanations", "query_id")).alias("output_text")
    )


def parse_explanations(answered: DataFrame, text: str = "output_text") -> DataFrame:
    """Explanations array with parse and schema flags; an empty list is not schema-valid."""
    parsed = answered.withColumn("_body", extract_json(text)).withColumn(
        "_o", F.from_json("_body", EXPLANATION_SCHEMA)
    )
    ok = is_json_object(F.col("_body"))
    kind = "array<struct<item_id:string,explanation:string,evidence_item_ids:array<string>," \
        "evidence_fields:array<string>,confidence:double>>"
    none, strings = F.array().cast(kind), F.array().cast("array<string>")
    cleaned = F.transform(
        F.filter(F.coalesce("_o.explanations", none), lambda x: x.isNotNull()),
        lambda x: F.struct(
            F.coalesce(x["item_id"], F.lit("")).alias("item_id"),
            F.coalesce(x["explanation"], F.lit("")).alias("explanation"),
            F.array_distinct(
                F.filter(
                    F.transform(F.coalesce(x["evidence_item_ids"], strings), lambda i: F.trim(i)),
                    lambda i: i != "",
                )
            ).alias("evidence_item_ids"),
            F.coalesce(x["evidence_fields"], strings).alias("evidence_fields"),
            F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"),
        ),
    )
    return (
        parsed.withColumn("parse_success", ok)
        .withColumn("explanations", F.when(F.col("parse_success"), cleaned).otherwise(none))
        .withColumn("schema_valid", F.col("parse_success") & (F.size("explanations") > 0))
        .drop("_body", "_o")
    )


def grounded_explanations(
    evidence: DataFrame, answered: DataFrame | None = None, provider: str = "mock", model: str = "rules"
) -> DataFrame:
    """Model explanations, replaced by template ones where unparsed, invalid or unfaithful."""
    answered = rule_explanation_text(evidence) if answered is None else answered
    checked = faithfulness(parse_explanations(answered), evidence)
    names = ("explanations", "missing_evidence_count", "ungrounded_claim_count", "explanation_faithful")
    spare = template_explanations(evidence).select(
        "query_id", *[F.col(n).alias(f"_{n}") for n in names]
    )
    failed = ~F.col("parse_success") | ~F.col("schema_valid") | ~F.col("explanation_faithful")
    joined = checked.join(spare, "query_id", "left").withColumn("used_fallback", failed)
    return joined.withColumns(
        {n: F.when(F.col("used_fallback"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    ).select(
        "query_id",
        *names,
        F.lit("evidence_grounded_llm_explanation").alias("method"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        "parse_success",
        "schema_valid",
        "used_fallback",
        F.lit(0.0).alias("estimated_cost_usd"),
    )


def explanation_rows(explained: DataFrame, splits: DataFrame) -> DataFrame:
    """Explanation outputs in the shape of per-query generation metrics."""
    return explained.join(splits.select("query_id", "split"), "query_id").select(
        "query_id",
        "method",
        "provider",
        "model",
        "split",
        F.col("parse_success").alias("output_parse_success"),
        "schema_valid",
        "used_fallback",
        "explanation_faithful",
        "estimated_cost_usd",
    )


def hallucination_flags(outputs: DataFrame) -> DataFrame:
    """Invalid ids over emitted plus invalid ids: the stricter of the two denominators."""
    invalid, emitted = F.size("invalid_item_ids"), F.size("recommended_item_ids")
    total = invalid + emitted
    return outputs.withColumns(
        {
            "invalid_item_count": invalid,
            "invalid_share": F.when(total > 0, invalid / total).otherwise(F.lit(0.0)),
        }
    )
