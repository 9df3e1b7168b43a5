"""Bounded scores and price labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions.text import _col

SCORE_DIGITS = 9


def price_bucket(price: Column | str) -> Column:
    value = F.coalesce(_col(price), F.lit(0.0))
    return F.when(value < 50, "low").when(value < 100, "mid").when(value < 200, "high").otherwise("premium")


def price_preference(avg_price: Column | str) -> Column:
    value = _col(avg_price)
    return (
        F.when(value.isNull(), "unknown")
        .when(value < 50, "budget")
        .when(value < 150, "mid_range")
        .otherwise("premium")
    )


def authority_score(avg_rating: Column | str, rating_count: Column | str) -> Column:
    """Clamped rating share times the log share of ratings, full at 5000."""
    rating = F.greatest(F.lit(0.0), F.least(F.coalesce(_col(avg_rating), F.lit(0.0)) / 5.0, F.lit(1.0)))
    count = F.greatest(F.coalesce(_col(rating_count), F.lit(0)), F.lit(0)).cast("double")
    return rating * F.least(F.log1p(count) / F.log1p(F.lit(5000.0)), F.lit(1.0))


def cold_start_score(popularity_count: Column | str) -> Column:
    return 1.0 / (1.0 + F.log1p(F.coalesce(_col(popularity_count), F.lit(0)).cast("double")))
