"""Joins and numbering that stay balanced when one key holds a large share of the rows.

A group counts as hot when it has at least ``spark.aisle.hotGroupRows`` rows and one in
``SHARE`` of the rows of all such groups. No more than ``SHARE`` groups can reach that, so hot keys
are a table of proven size that may be broadcast, and any other group is no more than a task's part of
large data. Salts and cuts of a hot group follow from its count. The counts of a frame are taken once
per application: they decide how rows are spread and never what a result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.session import cut_lineage

SHARE = 10_000
DEFAULT_HOT_ROWS = 1_000_000
LEAST_CUTS = 63
BROADCAST_ROWS = 100_000
#: Rows that a partition of a chosen layout holds.
PART_ROWS = 500_000
#: Frames whose hot keys are remembered.
REMEMBERED = 256


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.aisle.hotGroupRows", str(DEFAULT_HOT_ROWS)))


def _remembered(df: DataFrame) -> dict:
    """Hot keys of the frames of this application, by plan."""
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_aisle_hot"):
        context._aisle_hot = {}
    return context._aisle_hot


def hot_groups(
    df: DataFrame, keys: str | Sequence[str], rows: int | None = None
) -> DataFrame | None:
    """The hot key values of ``df`` and their ``_rows``, or None when there are none."""
    names = _names(keys)
    least = hot_rows(df) if rows is None else min(rows, hot_rows(df))
    known = _remembered(df)
    place = (df.semanticHash(), tuple(names), least)
    if place not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        counted = df.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("_rows"))
        known[place] = hot_of_counts(counted, least)
    return known[place]


def hot_of_counts(counted: DataFrame, least: int) -> DataFrame | None:
    """The hot groups of a frame that has the number of rows of each group as ``_rows``."""
    many = cut_lineage(counted.where(F.col("_rows") >= least))
    total = many.agg(F.sum("_rows")).first()[0]
    return None if total is None else many.where(F.col("_rows") >= total / SHARE)


def find_hot(
    keys_from: DataFrame, keys: Sequence[str], at_most: int | None = None
) -> DataFrame | None:
    """Hot groups, skipping the lookup when no group can reach the bar."""
    if at_most is not None and at_most < hot_rows(keys_from):
        return None
    return hot_groups(keys_from, keys)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting one past the limit."""
    return df.limit(rows + 1).count() <= rows


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    keys_from: DataFrame | None = None,
    hot: DataFrame | None = None,
    row_id: Sequence[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join where ``left`` may be hot on the key.

    ``keys_from`` is a cheap frame with the key distribution of ``left`` (a base table rather than
    a long plan), ``hot`` a ready list of hot keys with their ``_rows``. Rows of a hot key are spread
    over as many parts as it holds times the bar, and only the matching ``right`` rows are repeated,
    so the result is the plain join. With
    neither given the join is left to the adaptive skew join, which splits large partitions of
    the left side. ``how`` is inner, left, left_semi or left_anti; ``rows`` lowers the bar where
    each left row meets many right rows.
    """
    names = _names(on)
    if hot is None and keys_from is not None:
        hot = hot_groups(keys_from, names, rows)
    if hot is None:
        return left.join(right, names, how)
    least = hot_rows(left) if rows is None else min(rows, hot_rows(left))
    salts = F.ceil(F.col("_rows") / least).cast("int") + 1
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in (row_id or left.columns)]), F.col("_salts"))
    marks = F.broadcast(hot.select(*names, salts.alias("_salts")))
    salted_left = (
        left.join(marks, names, "left")
        .withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int"))
        .drop("_salts")
    )
    all_salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = (
        right.join(marks, names, "left").withColumn("_salt", F.explode(all_salts)).drop("_salts")
    )
    return salted_left.join(salted_right, [*names, "_salt"], how).drop("_salt")


def join_named(
    left: DataFrame, right: DataFrame, on: str, how: str = "inner", row_id: Sequence[str] | None = None
) -> DataFrame:
    """Join of many ``left`` rows that may name few different keys, with no move of ``left`` in that case.

    The rows of ``right`` that ``left`` names are sent to all tasks when they are few. Otherwise this is
    ``join`` with the hot keys of ``left``.
    """
    named = cut_lineage(left.select(on).distinct())
    found = cut_lineage(right.join(named, on, "left_semi")) if fits_broadcast(named) else None
    if found is not None and fits_broadcast(found):
        return left.join(F.broadcast(found), on, how)
    return join(left, right, on, how, keys_from=left, row_id=row_id)


def layout_parts(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows, so that a task's part of them stays small; no fewer than shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def _cuts_of(hot: DataFrame, least: int, parts: int) -> int:
    """Cuts for the largest hot group: a range for each bar that it holds, and no more than tasks need."""
    most = hot.agg(F.max("_rows")).first()[0]
    return max(LEAST_CUTS, min(-(-most // least), 4 * parts))


def row_number(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column],
    name: str,
    tie: Sequence[str],
    keys_from: DataFrame | None = None,
    at_most: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Exact ascending ``row_number`` per key with hot groups cut into ordered ranges.

    ``order`` columns sort ascending (negate a number to sort it down) and must be total; ``tie``
    names columns that identify a row inside its group and spread the choice of cuts. With no
    keys the whole frame is numbered, always in ranges and never in one task. Hot groups are
    looked up in ``keys_from``, a cheap frame whose groups are at least as large, or in ``df``; a
    known bound ``at_most`` on the group size saves the lookup when it is below the bar.
    """
    names = _names(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if names:
        if hot is None:
            hot = find_hot(df if keys_from is None else keys_from, names, at_most)
        if hot is None:
            window = Window.partitionBy(*names).orderBy(*order)
            return df.withColumn(name, F.row_number().over(window).cast("long"))
        cut_count = _cuts_of(hot, hot_rows(df), parts)
        marks = hot.select(*names, F.lit(True).alias("_hot"))
        marked = df.join(F.broadcast(marks), names, "left")
    else:
        names = ["_all"]
        cut_count = max(LEAST_CUTS, 4 * parts)
        marked = df.withColumn("_all", F.lit(0)).withColumn("_hot", F.lit(True))

    keyed = marked.withColumn("_key", F.struct(*order))
    by_hash = Window.partitionBy(*names).orderBy(F.xxhash64(*[F.col(c) for c in tie]))
    cuts = (
        keyed.where("_hot")
        .select(*names, "_key", *[c for c in tie if c not in names])
        .withColumn("_pick", F.row_number().over(by_hash))
        .where(F.col("_pick") <= cut_count)
        .groupBy(*names)
        .agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))
    )
    placed = (
        keyed.join(F.broadcast(cuts), names, "left")
        .withColumn(
            "_range",
            F.when(
                F.col("_hot"), F.size(F.filter("_cuts", lambda cut: cut <= F.col("_key")))
            ).otherwise(F.lit(0)),
        )
        .drop("_cuts")
    )
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.where("_hot")
        .groupBy(*names, "_range")
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.sum("_size").over(before))
        .where(F.col("_before").isNotNull())
        .drop("_size")
    )
    inside = Window.partitionBy(*names, "_range").orderBy("_key")
    out = (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*names, "_range"], "left")
        .withColumn(
            name, (F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))).cast("long")
        )
        .drop("_inside", "_before", "_range", "_key", "_hot")
    )
    return out.drop("_all") if names == ["_all"] else out
