"""Mixing sources to target weights with hash-threshold histograms, DataFrame functions only.

Every row has a keyed hash of 60 bits. A source takes ``whole`` copies of each of its rows and one
more of the rows whose hash lies below the source's cut. To find the cut, words are summed by source
and hash bucket (10 bits at a time); the bucket in which the budget ends is refined by the next 10
bits, and only its rows are summed again. No row is ever sorted. Cuts are nested: a larger budget
takes all that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.llm.common import materialise, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BUCKET_BITS = 10
LEVELS = 6


def row_hash(seed: int, doc_id: str, text: str) -> Column:
    """60 bits from the id and the text, so that a rerun draws the same rows."""
    keyed = F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(F.coalesce(F.col(text), F.lit(""))))
    return F.shiftrightunsigned(keyed, 4)


def source_key(source: str) -> Column:
    """A text that also tells null from every other source and sorts null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(
        F.concat(F.lit("0"), F.col(source).cast("string"))
    )


def _targets(
    sources: DataFrame, weights: Sequence[int], share: float, cap: float
) -> DataFrame:
    """Adds each source's target: weighted shares of ``share`` times all words, capped.

    Raising the level until no share passes its cap is what resharing the excess by weight ends in;
    each round is one aggregation over the table of sources.
    """
    placed = skew.row_number(sources, [], [F.col("_source_key")], "_place", ["_source_key"])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialise(placed.withColumn("_weight", weight), "mix-sources")
    most = F.lit(float(cap)) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        capped = most <= F.lit(level) * F.col("_weight")
        fixed, free = weighed.agg(
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if not free:
            break
        raised = (share * total - fixed) / free
        if raised <= level:
            break
        level = raised
    target = F.least(most, F.lit(level) * F.col("_weight"))
    return weighed.withColumn("target", target).drop("_weight", "_place")


def mixing_plan(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = MOST_COPIES,
) -> DataFrame:
    """One row per source: ``_source_key, source_size, target, whole, cut``.

    ``rows`` has ``_source_key`` (from ``source_key``), ``size`` and ``_hash``. ``whole`` copies of every
    row are taken and one more where the hash is below ``cut``. In the last bucket the end that is
    nearer to the target is chosen.
    """
    sizes = rows.groupBy("_source_key").agg(F.sum("size").alias("source_size"))
    planned = _targets(materialise(sizes, "mix-sizes"), weights, share, cap)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = planned.withColumn("whole", whole).withColumns(
        {
            "_budget": F.col("target") - F.col("whole") * F.col("source_size"),
            "_prefix": F.lit(0).cast("long"),
            "_open": F.lit(True),
        }
    )
    kept = ["_source_key", "source_size", "target", "whole"]
    for level in range(LEVELS):
        shift = 60 - BUCKET_BITS * (level + 1)
        inside = state.where("_open").select("_source_key", "_prefix", "_budget")
        bucketed = rows.withColumns(
            {
                "_prefix": F.shiftrightunsigned("_hash", shift + BUCKET_BITS),
                "_bucket": F.shiftrightunsigned("_hash", shift),
            }
        )
        sums = (
            bucketed.join(inside.select("_source_key", "_prefix"), ["_source_key", "_prefix"])
            .groupBy("_source_key", "_prefix", "_bucket")
            .agg(F.sum("size").alias("_size"), F.count("*").alias("_rows"))
        )
        run = Window.partitionBy("_source_key").orderBy("_bucket")
        cumulated = sums.join(inside, ["_source_key", "_prefix"]).withColumn(
            "_through", F.sum("_size").over(run)
        )
        boundary = (
            cumulated.where(F.col("_through") > F.col("_budget"))
            .groupBy("_source_key")
            .agg(F.min_by(F.struct("_bucket", "_size", "_through", "_rows"), "_bucket").alias("_b"))
        )
        left = F.col("_budget") - F.col("_b._through") + F.col("_b._size")
        # a bucket of one row, or the last bits: take the end nearer to the budget
        last = (F.col("_b._rows") == 1) | F.lit(level == LEVELS - 1)
        take = (F.col("_b._size") - left) < left
        at = F.col("_b._bucket")
        prefix = (
            F.when(~F.col("_open"), F.shiftleft("_prefix", BUCKET_BITS))
            .when(F.col("_b").isNull(), F.shiftleft(F.col("_prefix") + 1, BUCKET_BITS))
            .when(last, at + take.cast("long"))
            .otherwise(at)
        )
        state = materialise(
            state.join(boundary, "_source_key", "left").select(
                *kept,
                F.coalesce(F.when(F.col("_open"), left), F.col("_budget")).alias("_budget"),
                (F.col("_open") & F.col("_b").isNotNull() & ~last).alias("_open"),
                prefix.alias("_prefix"),
            ),
            "mix-level",
        )
        if state.where("_open").isEmpty():
            cut = F.shiftleft("_prefix", shift)
            break
    return state.select(*kept, cut.alias("cut"))


def mixing_rows(
    docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """What the plan needs of each document, without its text."""
    return materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            source_key(source).alias("_source_key"),
            word_count(F.col(text)).alias("size"),
            row_hash(seed, doc_id, text).alias("_hash"),
        ),
        "mix-rows",
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = MOST_COPIES,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document with the words that the mix takes of it.

    Columns ``doc_id, size, source_size, target, taken``. Null texts have size 0 and take 0 words, a
    null source is a source of its own and comes last, repeated rows are decided alike, a source of
    size 0 has target 0, an empty table gives an empty result. Other columns are not read.
    """
    rows = mixing_rows(docs, seed, doc_id, text, source)
    plan = mixing_plan(rows, weights, share, cap)
    copies = F.col("whole") + (F.col("_hash") < F.col("cut")).cast("long")
    return rows.join(plan, "_source_key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = MOST_COPIES,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The documents of the mix with all their columns, a document taken twice as two rows."""
    plan = mixing_plan(mixing_rows(docs, seed, doc_id, text, source), weights, share, cap)
    marked = docs.withColumns(
        {"_mix_key": source_key(source), "_mix_hash": row_hash(seed, doc_id, text)}
    )
    plan = plan.select(F.col("_source_key").alias("_mix_key"), F.col("whole").alias("_mix_whole"), F.col("cut").alias("_mix_cut"))
    copies = F.col("_mix_whole") + (F.col("_mix_hash") < F.col("_mix_cut")).cast("long")
    repeated = F.explode(F.array_repeat(F.lit(True), copies.cast("int")))
    return (
        marked.join(plan, "_mix_key")
        .select(*[docs[c] for c in docs.columns], repeated.alias("_mix_copy"))
        .drop("_mix_copy")
    )
