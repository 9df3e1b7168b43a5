"""Hard negatives by a vertical branch-and-bound scan over quantised vectors.

Rows are dealt into blocks of bounded size, and a task lays the dimensions of a block out as columns
with their least and largest values. An anchor reads the columns in the order of its own descending
magnitudes. After every few columns the least and most that the remaining ones can add bound each
candidate's score, and a bitmap of candidates shrinks: the search for positives drops those that
cannot reach the k-th best lower bound, the search for negatives those that can lie in no window of
scores or are behind k candidates that surely do. What is left at the last column has its exact score.

Rows move once per search and stay in their block; anchors, a stated query set, are sent to every
block in row form and stream past it, so a task holds one block and one batch of anchors. Each block
returns at most k rows per anchor (or window), which are combined before they are shuffled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take
no part. Shorter vectors count as zero beyond their end, an empty vector as zero. Rows that share an
id are the same item and never each other's positives or negatives; repeated anchors are answered
each. Ties go to the smaller id. An empty table gives no rows; other columns do not matter. Scores
are computed in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.common import materialise

BLOCK_ROWS = 16_384
#: Columns read between two looks at the bounds.
STRIDE = 8
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT = 50
MOST_PERCENT = 95


class Columns:
    """Some rows of a block: one array per dimension, ids, and the bounds of every dimension."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.values = values
        self.ids = ids
        none = np.zeros(len(values), values.dtype)
        self.least = values.min(axis=1) if values.shape[1] else none
        self.most = values.max(axis=1) if values.shape[1] else none


Prune = Callable[[np.ndarray, np.ndarray], np.ndarray]


def vertical_scan(rows: Columns, anchor: np.ndarray, bitmap: np.ndarray, prune: Prune):
    """Places of the candidates that survive every look at the bounds, and their exact scores."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[: np.count_nonzero(anchor)]
    ends = anchor * rows.least, anchor * rows.most
    least = np.minimum(*ends)[order]
    most = np.maximum(*ends)[order]
    rest_least = np.append(np.cumsum(least[::-1])[::-1], 0)
    rest_most = np.append(np.cumsum(most[::-1])[::-1], 0)
    places = np.flatnonzero(bitmap)
    scores = np.zeros(len(places), rows.values.dtype)
    whole = len(places) == len(bitmap)
    for start in range(0, len(order), STRIDE):
        dims = order[start : start + STRIDE]
        if whole:
            scores += anchor[dims] @ rows.values[dims]
        else:
            for d in dims:
                scores += anchor[d] * rows.values[d][places]
        end = start + len(dims)
        keep = prune(scores + rest_least[end], scores + rest_most[end])
        if not keep.all():
            places, scores, whole = places[keep], scores[keep], False
        if not len(places):
            break
    return places, scores


def _first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best by score, then id."""
    best = np.lexsort((ids[places], -scores))[:k]
    return ids[places[best]], scores[best]


def best_rows(rows: Columns, anchor: np.ndarray, bitmap: np.ndarray, k: int):
    """Ids and scores of the ``k`` best candidates."""

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return _first(*vertical_scan(rows, anchor, bitmap, prune), rows.ids, k)


def window_rows(
    rows: Columns, anchor: np.ndarray, bitmap: np.ndarray, windows: list[tuple[int, int]], k: int
):
    """For every window (least, most) of scores the ids and scores of the ``k`` best candidates in it."""
    spans = sorted({w for w in windows if w[0] <= w[1]})

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for least, most in spans:
            able = (upper >= least) & (lower <= most)
            sure = lower[(lower >= least) & (upper <= most)]
            if len(sure) >= k:
                able &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= able
        return keep

    none = np.zeros(0, np.int64), np.zeros(0, rows.values.dtype)
    if not spans:
        return [none] * len(windows)
    places, scores = vertical_scan(rows, anchor, bitmap, prune)
    found = {}
    for least, most in spans:
        inside = (scores >= least) & (scores <= most)
        found[least, most] = _first(places[inside], scores[inside], rows.ids, k)
    return [found.get(w, none) for w in windows]


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """The rows of a list column, padded with zeros."""
    out = np.zeros((len(column), dims), kind)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dims).astype(kind)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[row, : b - a] = values[a:b]
    return out


class Block:
    """The rows of one block by label, and the columns of all of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.labels = labels
        self.all = Columns(np.ascontiguousarray(values.T), ids)
        self._same: dict[int, Columns] = {}

    def same(self, label: int) -> Columns:
        if label not in self._same:
            own = np.flatnonzero(self.labels == label)
            self._same[label] = Columns(
                np.ascontiguousarray(self.all.values[:, own]), self.all.ids[own]
            )
        return self._same[label]


def _streamed(dims: int, kind: str, answer) -> Callable:
    """Task over rows in order of ``part, kind``: rows of a block, then the anchors that look at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts, block = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            anchors = batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(anchors) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if numbers[a] != part:
                    part, parts, block = numbers[a], [], None
                if not anchors[a]:
                    parts.append(
                        (
                            piece.column(3).to_numpy(),
                            piece.column(4).to_numpy(),
                            _matrix(piece.column(5), dims, kind),
                        )
                    )
                    continue
                if block is None and parts:
                    block = Block(*[np.concatenate(columns) for columns in zip(*parts)])
                    parts = []
                if block is not None:
                    yield from answer(block, piece)

    return run


def _positives(dims: int, kind: str, k: int):
    def answer(block: Block, piece: pa.RecordBatch):
        out: list[tuple] = []
        matrix = _matrix(piece.column(5), dims, kind)
        columns = (piece.column(i).to_pylist() for i in (2, 3, 4))
        for row, own, label, anchor in zip(*columns, matrix):
            rows = block.same(label)
            ids, scores = best_rows(rows, anchor, rows.ids != own, k)
            out += zip([row] * len(ids), ids.tolist(), scores.astype(np.int64).tolist())
        arrays = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "id", "score"])

    return answer


def _negatives(dims: int, kind: str, k: int, least: int, most: int):
    def bounds(score: int) -> tuple[int, int]:
        return -(-least * score // 100), most * score // 100

    def answer(block: Block, piece: pa.RecordBatch):
        out: list[tuple] = []
        matrix = _matrix(piece.column(5), dims, kind)
        columns = (piece.column(i).to_pylist() for i in (2, 3, 4, 6))
        for row, own, label, positives, anchor in zip(*columns, matrix):
            bitmap = (block.labels != label) & (block.all.ids != own)
            windows = [bounds(score) for score in positives]
            for place, (ids, scores) in enumerate(window_rows(block.all, anchor, bitmap, windows, k)):
                values = ids.tolist(), scores.astype(np.int64).tolist()
                out += zip([row] * len(ids), [place] * len(ids), *values)
        arrays = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "place", "id", "score"])

    return answer


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Every component as ``floor(scale * x)``."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(items: DataFrame, item: str, label: str, vector: str) -> DataFrame:
    """``row, id, label, q`` of the rows that take part."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)),
    )
    valid = items.where(
        F.col(item).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    )
    return valid.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(item).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        quantised(F.col(vector)).alias("q"),
    )


def _side(df: DataFrame, anchor: int, part: Column, scores: Column) -> DataFrame:
    kind = F.lit(anchor).alias("kind")
    return df.select(part.alias("part"), kind, "row", "id", "label", "q", scores.alias("scores"))


def hard_negatives(
    items: DataFrame,
    anchors: Column,
    item: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``id``. An anchor's positives are the best other rows of its label;
    for each of them the best rows of other labels whose score lies in its window are returned.
    """
    rows = materialise(usable(items, item, label, vector), "vectors")
    size, dims, largest = rows.agg(
        F.count("*"),
        F.max(F.size("q")),
        F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))),
    ).first()
    dims, largest = dims or 0, largest or 0
    # sums of products below 2^53 are exact as floating-point numbers
    kind = "float64" if dims * largest * largest < 1 << 53 else "int64"
    blocks = max(1, math.ceil(size / block_rows))
    no_scores = F.lit(None).cast("array<long>")
    held = _side(rows, 0, F.pmod(F.col("row"), F.lit(blocks)), no_scores)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asking = rows.where(anchors)

    def search(queries: DataFrame, scores: Column, task, schema: str) -> DataFrame:
        both = held.unionByName(_side(queries, 1, everywhere, scores))
        placed = both.repartition("part").sortWithinPartitions("part", "kind", "row")
        return placed.mapInArrow(_streamed(dims, kind, task), schema)

    found = search(
        asking, no_scores, _positives(dims, kind, positives), "anchor long, id long, score long"
    )
    by_score = (F.col("score").desc(), F.col("id"))
    best = Window.partitionBy("anchor").orderBy(*by_score)
    near = materialise(
        found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives),
        "positives",
    )
    listed = near.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias(
            "listed"
        )
    )
    far = search(
        asking.join(listed, F.col("row") == F.col("anchor")).drop("anchor"),
        F.col("listed"),
        _negatives(dims, kind, negatives, least_percent, most_percent),
        "anchor long, place long, id long, score long",
    )
    in_window = Window.partitionBy("anchor", "place").orderBy(*by_score)
    ranked = far.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= negatives)
    pairs = near.select(
        "anchor", F.col("place").cast("long"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        ranked.join(pairs, ["anchor", "place"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
