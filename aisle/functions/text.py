"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The item fields searched by default.
ITEM_TEXT_FIELDS = ("title", "category", "brand", "description")
TOKEN = "[a-z0-9]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Lower-cased text with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


def tokenize(c: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.coalesce(tokenize(c), F.array().cast("array<string>")))


def item_text(fields: Sequence[str] = ITEM_TEXT_FIELDS) -> Column:
    """Present fields joined with a space, normalised."""
    return normalize_text(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))


def token_overlap(query_tokens: Column, text: Column | str) -> Column:
    """Share of distinct query tokens found in the text; 0 when either side is empty."""
    wanted = F.array_distinct(query_tokens)
    found = F.size(F.array_intersect(wanted, token_set(text)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def shares_token(query_tokens: Column, text: Column | str) -> Column:
    hit = F.size(F.array_intersect(query_tokens, token_set(text))) > 0
    return hit.cast("double")


def truncate_text(c: Column | str, max_chars: int = 240) -> Column:
    """Whitespace-collapsed text cut to ``max_chars`` with a trailing ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(cut)


def token_count(c: Column | str) -> Column:
    """Whitespace-separated word count."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(r"\S+"), F.lit(0)))


def estimated_cost(prompt_tokens: Column, completion_tokens: Column, provider: Column) -> Column:
    """Token cost estimate; the built-in rule provider is free."""
    paid = prompt_tokens * F.lit(1e-6) + completion_tokens * F.lit(2e-6)
    return F.when(F.lower(provider) == "mock", F.lit(0.0)).otherwise(paid)


def hashed_order(*parts: Column | str) -> Column:
    """Portable pseudo-random order: md5 over the parts joined with a colon."""
    return F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts]))


def hashed_int(*parts: Column | str) -> Column:
    """Non-negative 32-bit integer drawn from ``hashed_order``."""
    return F.conv(F.substring(hashed_order(*parts), 1, 8), 16, 10).cast("long")
