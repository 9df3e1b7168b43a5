"""Query generation from catalog rows and rule-based query understanding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions import jsonx
from aisle.functions import query_rules as rules
from aisle.functions.jsonx import extract_json
from aisle.functions.text import hashed_order, normalize_text, tokenize
from aisle.operators import phrases
from aisle.operators.splits import query_split

# Use cases per category label and the ones for any other category.
USE_CASES_BY_CATEGORY = {
    "sports & outdoors": ("running", "outdoor", "beginner"),
    "beauty": ("dry skin", "gift", "beginner"),
    "electronics": ("travel", "office", "school"),
    "clothing": ("walking", "office", "travel"),
    "health & personal care": ("gym", "travel", "gift"),
}
OTHER_USE_CASES = ("gift", "travel", "beginner")


def query_price_label(price: Column | str) -> Column:
    value = F.col(price) if isinstance(price, str) else price
    return F.when(value < 30, "budget").when(value >= 120, "premium").otherwise("affordable")


def slug(c: Column) -> Column:
    flat = F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "_")
    flat = F.regexp_replace(flat, "^_+|_+$", "")
    return F.when(flat != "", flat).otherwise("query")


def generate_queries(
    items: DataFrame,
    queries_per_item: int = 3,
    seed: int = 42,
    include: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Positive query-item pairs: templates per item, a hashed choice of them, ids and a split.

    Everything happens inside the item's own row, so no shuffle is needed.
    """
    wanted = {"title": True, "category": True, "brand": True, "use_case": True, "price": True}
    wanted.update(include or {})
    label = F.replace(normalize_text("category"), F.lit("&"), F.lit("and"))
    brand = normalize_text("brand")
    use_cases = F.array(*[F.lit(u) for u in OTHER_USE_CASES])
    for name, phrases in USE_CASES_BY_CATEGORY.items():
        use_cases = F.when(label == name, F.array(*[F.lit(p) for p in phrases])).otherwise(use_cases)
    price = query_price_label("price")
    none = F.lit(None).cast("string")

    def option(text: Column, source: str, use_case: Column = none, constraint: Column = none):
        return F.struct(
            normalize_text(text).alias("query_text"),
            F.lit(source).alias("source"),
            use_case.alias("use_case"),
            constraint.alias("price_constraint"),
        )

    options = []
    if wanted["title"]:
        options.append(option(F.col("title"), "title"))
    if wanted["category"]:
        options.append(option(F.concat(label, F.lit(" products")), "category"))
    if wanted["brand"]:
        text = F.concat(brand, F.lit(" "), label, F.lit(" product"))
        options.append(option(text, "brand_category"))
    if wanted["use_case"]:
        for place in range(3):
            phrase = use_cases[place]
            text = F.concat(phrase, F.lit(" "), label)
            options.append(option(text, "use_case", use_case=phrase))
    if wanted["price"]:
        text = F.concat(price, F.lit(" "), label)
        options.append(option(text, "price_category", constraint=price))
    prefix = F.when(F.col("avg_rating") >= 4.4, "high rated").otherwise("popular")
    options.append(option(F.concat(prefix, F.lit(" "), label, F.lit(" item")), "descriptive"))

    present = F.filter(F.array(*options), lambda o: F.coalesce(o["query_text"], F.lit("")) != "")
    ordered = F.array_sort(
        F.transform(
            F.array_distinct(present),
            lambda o: F.struct(
                hashed_order(F.lit(seed), F.col("item_id"), o["source"], o["query_text"]).alias("h"),
                o.alias("o"),
            ),
        )
    )
    chosen = items.select(
        F.col("item_id").alias("target_item_id"),
        "category",
        "brand",
        F.posexplode(F.slice(ordered, 1, max(0, queries_per_item))).alias("place", "pick"),
    )
    query_id = F.format_string(
        "q_%s_%02d_%s",
        slug(F.col("target_item_id").cast("string")),
        F.col("place") + 1,
        slug(F.col("pick.o.source")),
    )
    return chosen.select(
        query_id.alias("query_id"),
        F.col("pick.o.query_text").alias("query_text"),
        "target_item_id",
        "category",
        rules.classify_intent(F.col("pick.o.query_text")).alias("intent"),
        F.col("pick.o.source").alias("source"),
        "brand",
        F.col("pick.o.price_constraint").alias("price_constraint"),
        F.col("pick.o.use_case").alias("use_case"),
        F.lit(1).alias("relevance_label"),
    ).withColumn("split", query_split("query_id", seed))


_PARSED = ("normalized_query", "intent", "category", "brand", "price_constraint", "use_case")


def parse_queries(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Intent, category, brand, price constraint and use case of every query text.

    Categories and brands are those of ``items``, the first one in order of value wins.
    """
    known = phrases.with_known(queries, items)
    return known.select(
        *[c for c in queries.columns if c not in _PARSED],
        normalize_text("query_text").alias("normalized_query"),
        rules.classify_intent("query_text").alias("intent"),
        F.col("known_category").alias("category"),
        F.col("known_brand").alias("brand"),
        rules.extract_price("query_text").alias("price_constraint"),
        rules.extract_use_case("query_text").alias("use_case"),
    )


def apply_query_understanding(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Generated pairs whose fields are replaced by the parsed ones where those exist."""
    known = phrases.with_known(pairs, items)
    return known.select(
        *[c for c in pairs.columns if c not in _PARSED],
        rules.classify_intent("query_text").alias("intent"),
        F.coalesce("known_category", "category").alias("category"),
        F.coalesce("known_brand", "brand").alias("brand"),
        F.coalesce(rules.extract_price("query_text"), "price_constraint").alias("price_constraint"),
        F.coalesce(rules.extract_use_case("query_text"), "use_case").alias("use_case"),
    )


def query_understanding(pairs: DataFrame, items: DataFrame, max_expanded: int = 3) -> DataFrame:
    """Source fields next to parsed fields with rewrite, expansion and confidence."""
    parsed = phrases.with_known(pairs, items).select(
        *_identity(pairs),
        *_sources(pairs),
        rules.classify_intent("query_text").alias("intent"),
        F.col("known_category").alias("category"),
        F.col("known_brand").alias("brand"),
        rules.extract_price("query_text").alias("price"),
        rules.extract_use_case("query_text").alias("use_case"),
    )
    fields = [F.col(c) for c in ("price", "brand", "category", "use_case")]
    return parsed.select(
        *_identity(pairs),
        *[f"source_{c}" for c in _PARSED[1:]],
        rules.null_if_unset(F.col("intent")).alias("parsed_intent"),
        rules.null_if_unset(F.col("category")).alias("parsed_category"),
        rules.null_if_unset(F.col("brand")).alias("parsed_brand"),
        rules.null_if_unset(F.col("price")).alias("parsed_price_constraint"),
        rules.null_if_unset(F.col("use_case")).alias("parsed_use_case"),
        rules.rewrite_query("query_text", *fields).alias("rewritten_query"),
        rules.expand_parsed_query("query_text", *fields, limit=max_expanded).alias(
            "expanded_queries"
        ),
        F.lit(0.9).alias("confidence"),
        F.lit(True).alias("parse_success"),
        F.lit(True).alias("schema_valid"),
        F.lit("mock").alias("provider"),
        F.lit(0.0).alias("estimated_cost_usd"),
    )


def _identity(pairs: DataFrame) -> list[str]:
    return ["query_id", "query_text", *[c for c in ("split", "target_item_id") if c in pairs.columns]]


def _sources(pairs: DataFrame) -> list[Column]:
    none = F.lit(None).cast("string")
    return [(F.col(c) if c in pairs.columns else none).alias(f"source_{c}") for c in _PARSED[1:]]


def read_query_understanding(
    answered: DataFrame, items: DataFrame, max_expanded: int = 3, text: str = "output_text"
) -> DataFrame:
    """Query fields as a model wrote them, row by row replaced by the rules where it failed.

    ``text`` holds an object in plain, fenced or surrounded form. Values of any type are read as text,
    price and use case from ``constraints`` first. An output that is no object gives the fields of the
    rules with confidence 0; a missing rewrite is made from the fields, expansions always start with
    the query itself. Confidence that is no number stays null.
    """
    rows = phrases.with_known(answered, items).withColumn("_o", F.try_parse_json(extract_json(text)))
    valid = jsonx.is_object(F.col("_o"))
    inner = F.when(
        jsonx.is_object(jsonx.member("_o", "constraints")), jsonx.member("_o", "constraints")
    )
    rows = rows.withColumns({"_valid": valid, "_inner": inner})

    def field(name: str, rule: Column, under: str | None = None) -> Column:
        own = jsonx.text_of(jsonx.member("_o", name))
        if under is not None:
            own = F.coalesce(jsonx.truthy_text(jsonx.member("_inner", under)), own)
        return F.when(F.col("_valid"), rules.null_if_unset(own)).otherwise(rule)

    rows = rows.withColumns(
        {
            "_intent": field("intent", rules.classify_intent("query_text")),
            "_category": field("category", F.col("known_category")),
            "_brand": field("brand", F.col("known_brand")),
            "_price": field("price_constraint", rules.extract_price("query_text"), "price"),
            "_use": field("use_case", rules.extract_use_case("query_text"), "use_case"),
        }
    )
    fields = [F.col(c) for c in ("_price", "_brand", "_category", "_use")]
    given = F.trim(jsonx.truthy_text(jsonx.member("_o", "rewritten_query")))
    rewritten = F.coalesce(
        F.when(F.col("_valid"), F.nullif(given, F.lit(""))), rules.rewrite_query("query_text", *fields)
    )
    listed = F.when(F.col("_valid"), jsonx.texts_of(jsonx.member("_o", "expanded_queries")))
    rows = rows.withColumns({"_rewritten": rewritten, "_listed": listed})
    expanded = F.when(
        F.col("_valid"), rules.bounded_queries(F.concat(F.array("query_text"), "_listed"), max_expanded)
    ).otherwise(
        rules.expand_query("query_text", F.col("_rewritten"), F.col("_category"), F.col("_use"), max_expanded)
    )
    known = F.col("_o").isNotNull()
    return rows.select(
        *_identity(answered),
        *_sources(answered),
        F.col("_intent").alias("parsed_intent"),
        F.col("_category").alias("parsed_category"),
        F.col("_brand").alias("parsed_brand"),
        F.col("_price").alias("parsed_price_constraint"),
        F.col("_use").alias("parsed_use_case"),
        F.col("_rewritten").alias("rewritten_query"),
        expanded.alias("expanded_queries"),
        F.when(F.col("_valid"), jsonx.number_of(jsonx.member("_o", "confidence")))
        .otherwise(F.lit(0.0))
        .alias("confidence"),
        F.col("_valid").alias("parse_success"),
        F.col("_valid").alias("schema_valid"),
        F.when(~known, "output is not JSON").when(~F.col("_valid"), "output is not a JSON object").alias(
            "parse_error"
        ),
        *[c for c in ("provider", "model", "latency_ms", "estimated_cost_usd") if c in answered.columns],
    )


def bag_of_words_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """Distinct tokens numbered alphabetically from 0."""
    tokens = texts.select(F.explode(tokenize(text)).alias("term")).distinct()
    numbered = skew.row_number(tokens, [], [F.col("term")], "n", ["term"])
    return numbered.select("term", (F.col("n") - 1).alias("idx"))


def bag_of_words(texts: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse counts (key, term, n, idx); tokens outside the vocabulary are ignored."""
    counts = (
        texts.select(key, F.explode(tokenize(text)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("n"))
    )
    return skew.join(counts, vocabulary, "term", keys_from=counts, row_id=[key])
