"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import SPACE_CHARS, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "be", "on", "are",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como",
)


class Rule(NamedTuple):
    """A document fails when ``top`` exceeds ``most`` times ``bottom``, or is below ``least`` times it."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Ratios over measured columns; ``from_words`` spares texts too short for a ratio to mean something.
RULES = (
    Rule("mean word length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols per word", "n_symbols", "n_words", most=0.1),
    Rule("words without letters", "n_bare_words", "n_words", most=0.3),
    Rule("exclamation marks per word", "n_bangs", "n_words", most=0.3),
    Rule("capital letters", "n_capitals", "word_chars", most=0.5, from_words=10),
    Rule("stop words", "n_stop_words", "n_words", least=0.02, from_words=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.3),
)


def _hash_windows(hashes: Column, n: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), n - (width - 1)),
        lambda i: F.xxhash64(*[F.element_at(hashes, (i + k).cast("int")) for k in range(width)]),
    )


def _repeated(width: int) -> str:
    """Words covered by windows that occur twice, from sorted ``(window, place)`` pairs.

    Neighbours with the same window mark both places; the marked places, in order, each cover the
    words up to the next one, ``width`` at most.
    """
    return f"""
      aggregate(
        array_sort(flatten(transform(array(array_sort(transform(sequence(1, n_words - {width - 1}),
          i -> struct(array_join(slice(_words, i, {width}), ' ') as w, i as at)))),
          s -> filter(transform(sequence(1, size(s)), j ->
            case when (j > 1 and s[j - 2].w = s[j - 1].w) or (j < size(s) and s[j].w = s[j - 1].w)
            then s[j - 1].at end), x -> x is not null)))),
        named_struct('n', 0L, 'end', 0L),
        (a, x) -> named_struct(
          'n', a.n + {width} - greatest(0L, a.end - x + 1), 'end', cast(x + {width - 1} as bigint)),
        a -> a.n)"""


def measured(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the counts that rules refer to; null texts count as empty.

    Windows are compared by hash first: a text whose hashes all differ repeats none. Only the others
    compare the windows' words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda condition: F.size(F.filter("_words", condition)).cast("long")
    bare = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    stops = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]
    base = docs.withColumns({"_words": words(F.col(text)), "_lines": lines})
    base = base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    windows = F.when(F.col("n_words") < width, F.array().cast("array<bigint>")).otherwise(
        _hash_windows(F.col("_hashes"), F.col("n_words").cast("int"), width)
    )
    base = base.withColumn("_windows", windows)
    alike = F.size(F.array_distinct("_windows")) < F.size("_windows")
    plain = F.lower(F.regexp_replace(body, r"[\p{Punct}]", ""))
    return base.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": bare(r"[#*$%&|<>]+"),
            "n_bangs": bare(r"!+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(alike, F.expr(_repeated(width))).otherwise(0).cast("long"),
            "n_bare_words": count(lambda w: ~w.rlike(r"\p{L}")),
            "n_capitals": F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long"),
            "n_stop_words": F.size(
                F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w.isin(*stops))
            ).cast("long"),
        }
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """True where every rule of the table holds."""
    holds = F.lit(True)
    for rule in rules:
        top, bottom = F.col(rule.top), F.col(rule.bottom)
        fails = F.lit(False)
        if rule.most is not None:
            fails = fails | (top > bottom * rule.most)
        if rule.least is not None:
            fails = fails | (top < bottom * rule.least)
        holds = holds & ~(fails & (F.col("n_words") >= rule.from_words))
    return holds


def quality_verdicts(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    A document fails the base with fewer than 10 words or with over a fifth of its words in repeated
    windows; it is kept if it passes the base and every rule. Null and empty texts have no words and
    fail. Each row is judged on its own, so repeated rows agree; other columns are not read.
    """
    counted = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & compile_rules(rules)).alias("kept"),
    )
