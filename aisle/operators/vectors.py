"""Exact vector search: items stay in blocks, queries stream past them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.scores import SCORE_DIGITS

QUERY_BLOCK = 512
ITEM_BLOCK = 4096
SPARSE_BLOCK = 65_536
BLOCK_BYTES = 32 << 20


def l2_normalize(vector):
    """Unit-length copy of an array column; a zero vector stays zero."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as one matrix; shorter rows end in zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dims).astype(float)
    out = np.zeros((len(sizes), dims))
    for row, (start, size) in enumerate(zip(offsets[:-1], np.minimum(sizes, dims))):
        out[row, :size] = values[start : start + size]
    return out


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, equal ones in order of their place."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def streamed(
    held: DataFrame, asking: DataFrame, keys: Sequence[str], task, schema: str, parts: int | None = None
) -> DataFrame:
    """Rows of ``held`` meet all rows of ``asking`` that share their ``keys``, block by block.

    Each row moves once. A task keeps the held rows of one block, which the caller bounds, and lets
    the asking rows stream past: ``task`` gets the batches of a block, the asking batch and gives
    batches of ``schema``. With ``parts`` the work is spread over that many tasks, however few bytes it moves.
    """
    names = [f"_{c}" for c in held.columns if c not in keys]
    left = held.select(*keys, F.lit(0).alias("_kind"), *[F.col(n[1:]).alias(n) for n in names])
    right = asking.select(*keys, F.lit(1).alias("_kind"), *[c for c in asking.columns if c not in keys])
    both = left.unionByName(right, allowMissingColumns=True)
    own = [both.columns.index(n) for n in names]
    others = [i for i, c in enumerate(both.columns) if i > len(keys) and c not in names]
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 1)]
            turns = np.zeros(batch.num_rows - 1, bool)
            for mark in marks:
                turns |= mark[1:] != mark[:-1]
            cuts = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = tuple(mark[a] for mark in marks[:width])
                if here != block:
                    block, parts = here, []
                piece = batch.slice(a, b - a)
                if marks[width][a] == 0:
                    parts.append(piece.select(own))
                elif parts:
                    if len(parts) > 1:
                        whole = pa.Table.from_batches(parts).combine_chunks()
                        parts = whole.to_batches()
                    yield from task(parts[0], piece.select(others), here)

    placed = both.repartition(*keys) if parts is None else both.repartition(parts, *keys)
    placed = placed.sortWithinPartitions(*keys, "_kind")
    return placed.mapInArrow(run, schema)


def _dense_scores(dims: int):
    """Scores of a batch of dense queries against the items of a block, as one matrix product."""

    def prepare(held: pa.RecordBatch):
        vectors = matrix(held.column(1), dims).T
        return lambda asking: matrix(asking.column(2), dims) @ vectors

    return prepare


def _sparse_scores(held: pa.RecordBatch):
    """The same for sparse vectors: the block's entries by place, summed up per query."""
    places = held.column(1).values.to_numpy(zero_copy_only=False)
    weights = held.column(2).values.to_numpy(zero_copy_only=False)
    bounds = held.column(1).offsets.to_numpy()
    places, weights = places[bounds[0] : bounds[-1]], weights[bounds[0] : bounds[-1]]
    items = np.repeat(np.arange(held.num_rows), np.diff(bounds))
    order = np.argsort(places, kind="stable")
    places, weights, items = places[order], weights[order], items[order]

    def score(asking: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((asking.num_rows, held.num_rows))
        for row, (own, values) in enumerate(zip(asking.column(2), asking.column(3))):
            own, values = own.values.to_numpy(), values.values.to_numpy(zero_copy_only=False)
            firsts, ends = np.searchsorted(places, own), np.searchsorted(places, own, "right")
            sizes = ends - firsts
            at = np.arange(sizes.sum()) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
            parts = np.repeat(values, sizes) * weights[at]
            out[row] = np.bincount(items[at], parts, held.num_rows)
        return out

    return score


def _best_of_block(k: int, prepare):
    """Best rows of a block for each query of a batch, a bounded number of queries at a time."""

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        held = held.take(pc.sort_indices(held.column(0)))
        items, scores_of = held.column(0), prepare(held)
        wanted = np.minimum(k + asking.column(1).to_numpy(), len(items))
        # scores of a chunk take no more memory in a large block than in a small one
        step = max(1, min(QUERY_BLOCK, QUERY_BLOCK * ITEM_BLOCK // len(items)))
        for start in range(0, asking.num_rows, step):
            part = asking.slice(start, step)
            scores = np.round(scores_of(part), SCORE_DIGITS)
            places = [first_k(row, count) for row, count in zip(scores, wanted[start:])]
            sizes = [len(p) for p in places]
            rows = np.repeat(np.arange(len(places)), sizes)
            at = np.concatenate(places)
            columns = [part.column(0).take(pa.array(rows)), items.take(pa.array(at)), pa.array(scores[rows, at])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "item_id", "score"])

    return search


def item_blocks(items: DataFrame, count: int, dims: int | None) -> tuple[int, int]:
    """(blocks of items, shares of queries) so that all cores have work.

    Every block gives a list per query and every query goes to every block, so blocks are as few as a task can
    hold: ``BLOCK_BYTES`` of dense vectors of ``dims``, or ``SPARSE_BLOCK`` items. Cores are kept busy by
    shares of the queries, which move the items again instead.
    """
    most = SPARSE_BLOCK if dims is None else max(ITEM_BLOCK, BLOCK_BYTES // (8 * max(1, dims)))
    blocks = max(1, math.ceil(count / most))
    return blocks, max(1, math.ceil(items.sparkSession.sparkContext.defaultParallelism / blocks))


def block_topk(
    queries: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` items per query by inner product, ranked by score down, then item id.

    ``queries`` (query_id) and ``items`` (item_id) hold dense ``vec`` or sparse ``idx``/``val``, whose
    cost follows the stored entries and not the number of places. Items are hashed into blocks of
    bounded size; each share of the queries streams past every block, which gives its best rows only.
    ``exclude`` (query_id, item_id) pairs are removed: every block returns as many rows more as the
    query has exclusions in it.
    """
    dense = "vec" in items.columns
    vector = ["vec"] if dense else ["idx", "val"]
    count, dims = items.agg(F.count("*"), F.max(F.size(vector[0]))).first()
    blocks, shares = item_blocks(items, count, (dims or 0) if dense else None)
    place = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    held = items.select(place.alias("block"), every.alias("share"), "item_id", *vector)
    asking = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asking.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    if exclude is not None:
        counted = exclude.withColumn("block", place).groupBy("query_id", "block").agg(
            F.count("*").alias("extra")
        )
        asking = asking.join(counted, ["query_id", "block"], "left")
        asking = asking.withColumn("extra", F.coalesce("extra", F.lit(0)))
    else:
        asking = asking.withColumn("extra", F.lit(0).cast("long"))
    ids = {f.name: f.dataType.simpleString() for f in (*queries.schema, *items.schema)}
    schema = f"query_id {ids['query_id']}, item_id {ids['item_id']}, score double"
    found = streamed(
        held,
        asking.select("block", "share", "query_id", "extra", *vector),
        ["block", "share"],
        _best_of_block(k, _dense_scores(dims or 0) if dense else _sparse_scores),
        schema,
        parts=skew.layout_parts(items, 0),
    )
    if exclude is not None:
        found = found.join(exclude, ["query_id", "item_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Exact cosine search over (query_id, vec) and (item_id, vec)."""
    return block_topk(
        queries.select("query_id", l2_normalize("vec").alias("vec")),
        items.select("item_id", l2_normalize("vec").alias("vec")),
        k,
    )


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact list that the approximate one contains, per query."""
    hit = found.select("query_id", "item_id", F.lit(1).alias("hit"))
    return (
        skew.join(exact, hit, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
