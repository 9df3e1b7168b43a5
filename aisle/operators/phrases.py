"""Known phrases in query texts, found by joins however many phrases there are.

A phrase can stand in a text only where each of its runs of word characters (or of other marks)
stands. Every phrase is keyed by the one of its runs that the fewest phrases have, texts meet the
table on their own runs, and the pairs that meet are checked in full. Texts are looked at once each,
however many queries share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.text import normalize_text

RUNS = r"(?U)\w+|[^\w\s]+"
#: Phrases that may stand inside a word are keyed by so many first characters.
KEY_CHARS = 6


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def known_phrases(items: DataFrame, column: str) -> DataFrame:
    """(value, flat): the distinct values of a column and their normalised texts."""
    values = items.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return values.withColumn("flat", normalize_text("value"))


def word_keys(phrases: DataFrame) -> DataFrame:
    """(value, flat, key): each phrase under its rarest run."""
    runs = phrases.where("flat <> ''").select(
        "value", "flat", F.explode(F.array_distinct(_runs(F.col("flat")))).alias("key")
    )
    counts = runs.groupBy("key").agg(F.count("*").alias("_n"))
    counted = skew.join(runs, counts, "key", keys_from=runs, row_id=["value"])
    return counted.groupBy("value", "flat").agg(F.min(F.struct("_n", "key")).alias("k")).select(
        "value", "flat", F.col("k.key").alias("key")
    )


def _meet(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Texts and phrases that share a key; a small table is sent to the texts."""
    if skew.fits_broadcast(table):
        return asked.join(F.broadcast(table), "key")
    return skew.join(asked, table, "key", keys_from=asked, row_id=["query_text"])


def _texts(queries: DataFrame) -> DataFrame:
    return queries.select("query_text").where("query_text is not null").distinct().withColumn(
        "text", normalize_text("query_text")
    )


def _first(hits: DataFrame, name: str) -> DataFrame:
    return hits.groupBy("query_text").agg(F.min("value").alias(name))


def whole_phrases(queries: DataFrame, phrases: DataFrame, name: str) -> DataFrame:
    """(query_text, name): the first phrase in order of value that stands in the text between word bounds."""
    asked = _texts(queries).withColumn("key", F.explode(F.array_distinct(_runs(F.col("text")))))
    met = _meet(asked, word_keys(phrases))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), "flat", F.lit(r"\E\b"))
    return _first(met.where(F.regexp_like("text", pattern)), name)


def contained_phrases(queries: DataFrame, phrases: DataFrame, name: str) -> DataFrame:
    """(query_text, name): the first phrase that the text contains, or one of whose words it has.

    Words are runs of ASCII letters and digits other than "and".
    """
    texts = _texts(queries)
    named = phrases.where("flat <> ''")
    words = F.array_remove(F.array_distinct(F.regexp_extract_all("flat", F.lit("[a-z0-9]+"), F.lit(0))), "and")
    by_word = named.select("value", F.explode(words).alias("key")).groupBy("key").agg(
        F.min("value").alias("value")
    )
    asked = texts.select("query_text", F.explode(F.array_distinct(_runs(F.col("text")))).alias("key"))
    by_words = _meet(asked, by_word).select("query_text", "value")
    inside = named.withColumn("key", F.substring("flat", 1, KEY_CHARS))
    # at most KEY_CHARS lengths
    sizes = [row[0] for row in inside.select(F.length("key")).distinct().collect()]
    none = F.array().cast("array<string>")
    grams = F.concat(none, *[_substrings(F.col("text"), n) for n in sizes])
    cut = texts.withColumn("key", F.explode(F.array_distinct(grams)))
    by_text = _meet(cut, inside).where(F.contains("text", "flat")).select("query_text", "value")
    return _first(by_words.unionByName(by_text), name)


def _substrings(text: Column, size: int) -> Column:
    """All substrings of so many characters in one pass over the text; none of a shorter text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def with_known(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``queries`` with ``known_category`` and ``known_brand`` of their texts."""
    categories = contained_phrases(queries, known_phrases(items, "category"), "known_category")
    brands = whole_phrases(queries, known_phrases(items, "brand"), "known_brand")
    # one row per text: its table is no larger than the distinct texts
    found = _texts(queries).select("query_text").join(categories, "query_text", "left").join(
        brands, "query_text", "left"
    )
    return skew.join(queries, found, "query_text", "left", keys_from=queries)
