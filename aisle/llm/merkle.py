"""Merkle manifest of a table: subtrees per group, one tree over their roots, proofs for every row.

Slot pivot: the children of a parent are spread into ``fanout`` columns by conditional aggregates.
Concatenating the columns gives the parent's digest, and leaving out a child's own column gives its
siblings. The trees grow upwards level by level, one shuffle of the last level's nodes each (a third
of the rows before for a fanout of three). Proofs come down the same tables: a parent hands its own
path to its children and puts their siblings in front, so a proof moves once per parent and no row
of the table is joined with more than its own parent.

Defined results: a null field is encoded as ``-`` and differs from an empty text. Rows without a
group value form the first group. Rows are ordered by id (null first), those with the same id by
their digest, so repeated rows get neighbouring places. An empty table gives no rows. Columns other
than the named ones play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.common import by_size, in_order, materialise, ranked

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def leaf_digest(fields: Sequence[str], instead: Mapping[str, Column] | None = None) -> Column:
    """Digest of a row's fields; ``instead`` replaces some of them."""
    instead = instead or {}
    return digest(F.concat(*[encoded(instead.get(f, F.col(f))) for f in fields]))


def group_key(value: Column) -> Column:
    """A text that is never null and sorts as null first, then bytewise."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


def _places(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``tree, pos, n, digest, item``: place in the tree and number of its leaves; and the largest ``n``.

    All rows are ordered in ranges, so a hot tree lies in many parts. A part needs to know only how
    many rows of its trees come in earlier parts.
    """
    placed = in_order(leaves, ["tree", "id", "digest", "seen", "_row"], "merkle-leaves")
    counts = placed.groupBy("_part", "tree").agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first")
    )
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        counts.select(
            "_part",
            "tree",
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(tree).alias("n"),
        ),
        "merkle-starts",
    )
    nodes = placed.join(by_size(starts), ["_part", "tree"]).select(
        "tree",
        (F.col("_at") + F.col("_shift")).alias("pos"),
        "n",
        "digest",
        F.struct("id", "seen").alias("item"),
    )
    return nodes, starts.agg(F.max("n")).first()[0] or 0


def _pivot(nodes: DataFrame, fanout: int, last: bool = False) -> DataFrame:
    """Parents of ``nodes``: ``tree, pos, n, d0.., [i0..], n_up, digest``; a lone node is its own parent."""
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == s, F.col("digest"))).alias(f"d{s}") for s in range(fanout)]
    if last:
        spread += [F.max(F.when(slot == s, F.col("item"))).alias(f"i{s}") for s in range(fanout)]
    joined = F.concat_ws("", *[F.col(f"d{s}") for s in range(fanout)])
    return (
        nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"), "n")
        .agg(*spread)
        .withColumn("n_up", F.ceil(F.col("n") / fanout))
        .withColumn("digest", F.when(F.col("n") > 1, digest(joined)).otherwise(F.col("d0")))
    )


def _ascend(nodes: DataFrame, most: int, fanout: int, name: str) -> list[DataFrame]:
    """One table of parents per level; ``most`` is the number of leaves of the largest tree."""
    levels = [materialise(_pivot(nodes, fanout, last=True), f"{name}-0")]
    left = math.ceil(most / fanout)
    while left > 1:
        below = levels[-1].where(F.col("n_up") > 1)
        kids = below.select("tree", "pos", F.col("n_up").alias("n"), "digest")
        levels.append(materialise(_pivot(kids, fanout), f"{name}-{len(levels)}"))
        left = math.ceil(left / fanout)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of every tree's root, wherever it stopped growing."""
    done = [level.where(F.col("n_up") == 1).select("tree", "digest") for level in levels]
    out = done[0]
    for rest in done[1:]:
        out = out.unionByName(rest)
    return out


def _children(parents: DataFrame, fanout: int, last: bool, carry: Sequence[str]) -> DataFrame:
    """The children of ``parents`` with their siblings in front of the parent's path."""
    kids = []
    for s in range(fanout):
        step = F.struct(
            F.concat_ws("", *[F.col(f"d{t}") for t in range(s)]).alias("left"),
            F.concat_ws("", *[F.col(f"d{t}") for t in range(s + 1, fanout)]).alias("right"),
        )
        parts = [
            (F.col("pos") * fanout + s).alias("pos"),
            F.col(f"d{s}").alias("digest"),
            step.alias("step"),
        ]
        kids.append(F.struct(*parts, *([F.col(f"i{s}").alias("item")] if last else [])))
    every = F.filter(F.array(*kids), lambda kid: kid["digest"].isNotNull())
    opened = parents.withColumn("_kid", F.explode(every))
    path = F.when(F.col("n") > 1, F.concat(F.array("_kid.step"), F.col("path")))
    return opened.select(
        "tree",
        F.col("_kid.pos").alias("pos"),
        path.otherwise(F.col("path")).alias("path"),
        *carry,
        *([F.col("_kid.digest").alias("digest"), F.col("_kid.item").alias("item")] if last else []),
    )


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``tree, pos, path, digest, item`` and what ``tops`` (tree, path, ...) carries, for every leaf."""
    carry = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for at in reversed(range(len(levels))):
        level = levels[at].drop("digest")
        known = level.where(F.col("n_up") == 1).join(tops, "tree")
        if above is not None:
            inner = level.where(F.col("n_up") > 1).join(above, ["tree", "pos"])
            known = known.unionByName(inner)
        above = _children(known, fanout, at == 0, carry)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(
        path, leaf, lambda own, step: digest(F.concat(step["left"], own, step["right"]))
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(
    docs: DataFrame,
    group: str = "source",
    order: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    seen: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: ``order, leaf, seen_leaf, subroot, root, path``.

    ``path`` lists the siblings from the leaf to the root as (left, right) pairs of joined digests.
    ``seen`` gives the fields as they are found now; ``seen_leaf`` is their digest, to be folded
    with the path of the original.
    """
    leaf = leaf_digest(fields)
    leaves = docs.select(
        group_key(F.col(group)).alias("tree"),
        F.col(order).alias("id"),
        leaf.alias("digest"),
        (leaf_digest(fields, seen) if seen else leaf).alias("seen"),
        F.monotonically_increasing_id().alias("_row"),
    )
    nodes, most = _places(materialise(leaves, "merkle-rows"))
    levels = _ascend(nodes, most, fanout, "merkle-groups")
    subroots = materialise(
        ranked(_tops(levels), ["tree"], "merkle-subroots", rank="pos"), "merkle-top"
    )
    count = subroots.count()
    top = subroots.select(
        F.lit("").alias("tree"),
        "pos",
        F.lit(count).cast("long").alias("n"),
        "digest",
        F.struct(F.col("tree").alias("id"), F.col("digest").alias("seen")).alias("item"),
    )
    upper = _ascend(top, count, fanout, "merkle-roots")
    found = _tops(upper).first()
    root = F.lit(found["digest"] if found else None).cast("string")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    start = _tops(upper).select("tree", empty.alias("path"))
    groups = _descend(upper, start, fanout).select(
        F.col("item.id").alias("tree"), "path", F.col("digest").alias("subroot")
    )
    groups = materialise(groups, "merkle-paths")
    rows = _descend(levels, groups, fanout)
    return rows.select(
        F.col("item.id").alias(order),
        F.col("digest").alias("leaf"),
        F.col("item.seen").alias("seen_leaf"),
        "subroot",
        root.alias("root"),
        "path",
    )


def verified_rows(rows: DataFrame) -> DataFrame:
    """Adds ``proof_sha256``, ``folded_root`` from the leaf as seen, and whether it is the root."""
    return rows.withColumns(
        {"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.col("seen_leaf"), F.col("path"))}
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
