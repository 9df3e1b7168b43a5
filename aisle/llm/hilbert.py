"""Sharding along a Hilbert curve over metadata dimensions, DataFrame functions only.

Each dimension is quantised into bins of about equal row counts, the bins of a row give its place on
the Hilbert curve, all rows are numbered along the curve and cut into runs. Rows that are near in
all dimensions share a run, so the minima and maxima of a run's files exclude it for most filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import materialise, ranked, running

BITS = 8
SHARDS = 24


def equal_bins(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``column`` and its ``bin``: the share of rows with smaller values, in ``2**bits`` steps.

    Null is a value of its own and the smallest. Works on the counts of distinct values.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("_rows"))
    placed = running(counts, [column], "_rows", "bins", "_earlier")
    total = rows.count()
    step = F.floor(F.col("_earlier") * F.lit(1 << bits) / F.lit(max(total, 1)))
    return placed.select(column, step.cast("long").alias("bin"))


def hilbert_index(bins: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell with ``bits`` bits in each dimension.

    The turns of the curve are undone from the highest bit down, then the Gray code is read off and
    the bits of the dimensions are interleaved.
    """
    dims = len(bins)
    steps = F.array(
        *[
            F.struct(F.lit(1 << bit).cast("long").alias("q"), F.lit(dim).alias("i"))
            for bit in range(bits - 1, 0, -1)
            for dim in range(dims)
        ]
    )

    def turn(cell: Column, step: Column) -> Column:
        low = step["q"] - 1
        first, own = cell[0], F.get(cell, step["i"])
        inside = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        change = F.when(inside, low).otherwise(swap)
        return F.transform(
            cell,
            lambda x, j: F.when(j == 0, x.bitwiseXOR(change))
            .when((j == step["i"]) & ~inside, x.bitwiseXOR(swap))
            .otherwise(x),
        )

    start = F.array(*[b.cast("long") for b in bins])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start

    def gray(cell: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.aggregate(
                F.slice(cell, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)
            ),
        )

    def fold(cell: Column) -> Column:
        last = F.get(cell, F.lit(dims - 1))
        flips = F.aggregate(
            F.array(*[F.lit(1 << bit).cast("long") for bit in range(bits - 1, 0, -1)]),
            F.lit(0).cast("long"),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return F.transform(cell, lambda x: x.bitwiseXOR(flips))

    places = F.array(
        *[
            F.struct(F.lit(bit).alias("bit"), F.lit(dim).alias("dim"))
            for bit in range(bits - 1, -1, -1)
            for dim in range(dims)
        ]
    )

    def interleave(cell: Column) -> Column:
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda acc, p: acc * 2
            + F.call_function("shiftright", F.get(cell, p["dim"]), p["bit"]).bitwiseAND(F.lit(1)),
        )

    # one-element arrays hold each step's result, so that it is evaluated once
    held = F.transform(F.array(turned), gray)
    held = F.transform(held, fold) if bits > 1 else held
    return F.transform(held, interleave)[0]


def hilbert_shards(
    docs: DataFrame,
    dimensions: Sequence[str] = ("source", "lang", "size"),
    shards: int = SHARDS,
    bits: int = BITS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    The law is ``rows``: shards are runs of the curve whose counts differ by one at most. ``size``
    (a possible dimension) is the number of UTF-8 bytes plus 8; null texts count as empty, null
    values are the lowest of their dimension. Equal texts stand side by side inside a cell; repeated
    rows take neighbouring slots. An empty table gives an empty result.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    kept = {
        "doc_id": F.col(doc_id),
        "size": (F.octet_length(data) + 8).cast("long"),
        "text_crc32": F.crc32(data),
    }
    names = [f"_dim{i}" for i in range(len(dimensions))]
    for name, dim in zip(names, dimensions):
        kept[name] = kept["size"] if dim == "size" else F.col(dim)
    rows = materialise(docs.select(*[c.alias(n) for n, c in kept.items()]), "shard-rows")
    binned = rows
    for name in names:
        bins = equal_bins(rows, name, bits).select(F.col(name).alias("_v"), F.col("bin").alias(f"{name}_bin"))
        binned = binned.join(bins, F.col(name).eqNullSafe(F.col("_v"))).drop("_v")
    curve = hilbert_index([F.col(f"{n}_bin") for n in names], bits)
    placed = ranked(
        binned.select("doc_id", "size", "text_crc32", curve.alias("curve")),
        ["curve", "text_crc32", "doc_id", "size"],
        "curve",
    )
    total = rows.count()
    exact = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", exact)
        .withColumn("slot", (F.col("rank") - start).cast("long"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )


def write_shards(
    docs: DataFrame,
    path: str,
    dimensions: Sequence[str] = ("source", "lang", "n_chars"),
    shards: int = SHARDS,
    bits: int = BITS,
) -> None:
    """Writes the rows in curve order, one file per run, with the statistics that readers prune by.

    Works on columns of ``docs`` as they are; nothing but a sort by ranges of the curve is shuffled.
    """
    marked = docs
    for i, dim in enumerate(dimensions):
        bins = equal_bins(docs, dim, bits).select(F.col(dim).alias("_v"), F.col("bin").alias(f"_bin{i}"))
        marked = marked.join(bins, F.col(dim).eqNullSafe(F.col("_v"))).drop("_v")
    curve = hilbert_index([F.col(f"_bin{i}") for i in range(len(dimensions))], bits)
    marked = marked.withColumn("_curve", curve)
    order = ["_curve", *[c for c in ("doc_id",) if c in docs.columns]]
    marked.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(
        *docs.columns
    ).write.parquet(path)
