"""Counting marks at or below a point inside large groups, by ranges instead of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew

PARTS = 256


def count_at_or_below(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    at: str,
    span: Column,
    name: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """For each point the number of marks of its group whose ``at`` is not above its own.

    Points and marks of a group meet in one running sum instead of in pairs. Groups listed in
    ``hot`` are cut into ``PARTS`` ranges of ``at`` (which lies in 0..span); the total of the lower
    ranges is carried into a range as one extra row ahead of its marks.
    """
    cells = [*keys, "_part"]
    counted = marks.groupBy(*keys, at).agg(F.count("*").alias("_n"))
    if hot is None:
        points, counted = (df.withColumn("_part", F.lit(0)) for df in (points, counted))
    else:
        marked = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
        width = F.greatest(span, F.lit(1)).cast("double")
        part = F.least(F.floor(F.col(at) * PARTS / width), F.lit(PARTS - 1)).cast("int")
        points, counted = (
            df.join(marked, list(keys), "left")
            .withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0)))
            .drop("_hot")
            for df in (points, counted)
        )
        totals = F.map_from_entries(F.collect_list(F.struct("_part", "_n")))
        lower = F.map_filter("_t", lambda p, n: p < F.col("_part"))
        zero = F.lit(0).cast("long")
        carried = (
            counted.join(marked, list(keys), "left_semi")
            .groupBy(*cells)
            .agg(F.sum("_n").alias("_n"))
            .groupBy(*keys)
            .agg(totals.alias("_t"))
            .withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(PARTS - 1))))
            .select(
                *cells,
                F.lit(-1).cast("long").alias(at),
                F.aggregate(F.map_values(lower), zero, lambda a, n: a + n).alias("_n"),
            )
        )
        counted = counted.unionByName(carried)
    running = Window.partitionBy(*cells).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    stacked = points.withColumns(
        {"_point": F.lit(True), "_n": F.lit(0).cast("long")}
    ).unionByName(counted, allowMissingColumns=True)
    return (
        stacked.withColumn(name, F.sum("_n").over(running)).where("_point").drop("_part", "_point", "_n")
    )


def nth_unlisted(
    numbered: DataFrame,
    listed: DataFrame,
    keys: Sequence[str],
    catalog_size: Column,
    below: int | None = None,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Replace the unlisted number ``_at`` of each row by its catalog place ``item_idx``.

    ``listed`` has the distinct listed places per group. With those sorted as a(1..s), unlisted
    number r lies at place r + 1 + count(a(i) - i <= r), so unlisted items are never enumerated.
    ``below`` states that every number is smaller, which lets all later gaps be skipped.
    """
    hot = skew.find_hot(listed if keys_from is None else keys_from, list(keys))
    order = [F.col("item_idx")]
    places = skew.row_number(listed, list(keys), order, "_i", ["item_idx"], at_most=0, hot=hot)
    gaps = places.select(*keys, (F.col("item_idx") - F.col("_i")).alias("_at"))
    if below is not None:
        gaps = gaps.where(F.col("_at") < below)
    span = catalog_size if below is None else F.lit(below)
    placed = count_at_or_below(numbered, gaps, keys, "_at", span, "_skipped", hot)
    return placed.withColumn("item_idx", F.col("_at") + F.col("_skipped") + 1).drop(
        "_at", "_skipped"
    )


def draw_unlisted(
    draws: DataFrame,
    listed: DataFrame,
    keys: Sequence[str],
    hashed: Column,
    catalog_size: Column,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Turn each draw into the catalog place of an item its group has not listed.

    ``draws`` has ``draw`` = 0.._k-1 per row with ``_k`` draws out of ``_free`` unlisted items.
    Draw d picks one unlisted number inside the d-th of ``_k`` equal ranges, so the draws of a
    row are distinct.
    """
    low, high = F.expr("draw * _free div _k"), F.expr("(draw + 1) * _free div _k")
    numbered = draws.withColumn("_at", low + hashed % (high - low)).drop("_k", "_free")
    return nth_unlisted(numbered, listed, keys, catalog_size, keys_from=keys_from)
