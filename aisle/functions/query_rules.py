"""Rule-based query understanding as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions.text import _col, normalize_text, tokenize

# The word lists of the query rules.
INTENT_PRICE_WORDS = ("cheap", "budget", "affordable", "under", "low cost", "deal", "discount")
CONSTRAINT_PRICE_WORDS = ("affordable", "budget", "cheap", "premium")
USE_CASES = (
    "beginner",
    "gym",
    "running",
    "travel",
    "dry skin",
    "walking",
    "outdoor",
    "office",
    "school",
    "gift",
)
CATEGORY_WORDS = (
    "sports",
    "outdoors",
    "beauty",
    "electronics",
    "clothing",
    "health",
    "personal care",
    "skincare",
)
KNOWN_BRANDS = ("nova", "orbit", "luma", "stride", "haven", "pulse", "aster", "kindlewood")


def _any_of(words: Sequence[str]) -> str:
    return "(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def _whole_word(word: str) -> str:
    return r"\b" + re.escape(word).replace(r"\ ", " ") + r"\b"


def classify_intent(query: Column | str) -> Column:
    text = normalize_text(query)
    words = F.array_distinct(tokenize(text))
    brands = F.array(*[F.lit(b) for b in KNOWN_BRANDS])
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(text.rlike(_any_of(INTENT_PRICE_WORDS)), "price_sensitive_search")
        .when(text.rlike(_any_of(USE_CASES)), "use_case_search")
        .when(F.arrays_overlap(words, brands), "brand_search")
        .when(text.rlike(_any_of(CATEGORY_WORDS)) & (F.size(words) <= 5), "category_search")
        .otherwise("product_search")
    )


def extract_price(query: Column | str) -> Column:
    text = normalize_text(query)
    # fixed pattern
    amount = F.regexp_extract(text, r"\bunder\s+\$?(\d+(?:\.\d+)?)\b", 1)
    result = F.when(
        amount != "", F.concat(F.lit("under_"), F.regexp_replace(amount, r"\.", "_"))
    )
    for word in CONSTRAINT_PRICE_WORDS:
        result = result.when(text.rlike(_whole_word(word)), word)
    return result


def extract_use_case(query: Column | str) -> Column:
    text = normalize_text(query)
    result = F.when(F.lit(False), "")
    for phrase in USE_CASES:
        result = result.when(text.rlike(_whole_word(phrase)), phrase)
    return result


def extract_category(query: Column | str, known: Sequence[str]) -> Column:
    """First known category contained in the query or sharing one of its words with it."""
    text = normalize_text(query)
    result = F.when(F.lit(False), "")
    for category in known:
        flat = " ".join(category.lower().split())
        words = [w for w in re.findall("[a-z0-9]+", flat) if w != "and"]
        hit = F.lit(False)
        if flat:
            hit = hit | text.contains(flat)
        if words:
            hit = hit | text.rlike(r"\b(" + "|".join(words) + r")\b")
        result = result.when(hit, category)
    return result


def extract_brand(query: Column | str, known: Sequence[str]) -> Column:
    text = normalize_text(query)
    result = F.when(F.lit(False), "")
    for brand in known:
        flat = " ".join(brand.lower().split())
        if flat:
            result = result.when(text.rlike(_whole_word(flat)), brand)
    return result


def rewrite_query(
    query: Column | str, price: Column, brand: Column, category: Column, use_case: Column
) -> Column:
    parts = [F.nullif(F.trim(p.cast("string")), F.lit("")) for p in (price, brand, category, use_case)]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined != "", normalize_text(joined)).otherwise(normalize_text(query))


def _distinct_texts(options: Sequence[Column], limit: int) -> Column:
    return bounded_queries(F.array(*options), limit)


def bounded_queries(options: Column, limit: int) -> Column:
    """The first ``limit`` distinct normalised texts of an array."""
    texts = F.transform(options, lambda x: normalize_text(x))
    kept = F.filter(texts, lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(kept), 1, limit)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def expand_query(
    query: Column | str, rewritten: Column, category: Column, use_case: Column, limit: int = 3
) -> Column:
    """Ordered distinct list of the query, its rewrite and its category with use case."""
    return _distinct_texts([_col(query), rewritten, _joined(category, use_case)], limit)


def expand_parsed_query(
    query: Column | str,
    price: Column,
    brand: Column,
    category: Column,
    use_case: Column,
    limit: int = 3,
) -> Column:
    """Expansion of the default rule model: query plus three combinations of parsed fields."""
    combos = [_joined(price, category, use_case), _joined(brand, category), _joined(use_case, category)]
    return _distinct_texts([_col(query), *combos], limit)


def null_if_unset(c: Column) -> Column:
    """Trimmed text with empty, none, null and unknown turned into null."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin("", "none", "null", "unknown"), text)
