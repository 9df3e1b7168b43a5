"""Fused BM25 and TF-IDF search over one table of postings with bounds per block of items.

The fused index keeps both weights of a posting side by side, as lists per item. Items that depend on
the same term most lie in the same block, strongest first, and every block knows the largest weights
of its terms. A query reads its most promising blocks first. What they hold bounds the k-th score and
both maxima from below, and a block is read afterwards only if its own bound reaches one of them.

A block does not know the normalisation, so it gives every row that could be among the best ``k``
under any: those that ``k`` other rows do not beat in both scores. Maxima, minima and counts of matches
come along with these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators import retrieval as r
from aisle.operators.matching import TermBlock
from aisle.operators.vectors import streamed
from aisle.session import cut_lineage

BLOCK_ITEMS = 2048
FIRST_BLOCKS = 2
#: Scores are rounded to this many digits; rows closer than a few units of it may change places.
MARGIN = 4 * 10.0**-r.SCORE_DIGITS


@dataclass
class FusedIndex:
    """``rows`` (block, item_id, terms, bm25, dense), ``bounds`` (block, term, bm25, dense, n)."""

    rows: DataFrame
    bounds: DataFrame
    item_ids: DataFrame
    encoders: tuple[r.TermIndex, r.TermIndex]
    size: int


def fused_index(bm25: r.TermIndex, tfidf: r.TermIndex) -> FusedIndex:
    zero = F.lit(0.0)
    both = bm25.postings.select("item_id", "term", F.col("weight").alias("bm25"), zero.alias("dense"))
    both = both.unionByName(
        tfidf.postings.select("item_id", "term", zero.alias("bm25"), F.col("weight").alias("dense"))
    )
    entry = F.struct("term", "bm25", "dense")
    listed = (
        both.groupBy("item_id", "term")
        .agg(F.sum("bm25").alias("bm25"), F.sum("dense").alias("dense"))
        .groupBy("item_id")
        .agg(
            F.collect_list(entry).alias("e"),
            F.max(F.struct("bm25", "term")).alias("_most"),
        )
    )
    size = bm25.item_ids.count()
    blocks = max(1, -(-size // BLOCK_ITEMS))
    placed = (
        listed.repartitionByRange(blocks, "_most.term", F.col("_most.bm25").desc(), "item_id")
        .withColumn("block", F.spark_partition_id())
        .select(
            "block",
            "item_id",
            F.col("e.term").alias("terms"),
            F.col("e.bm25").alias("bm25"),
            F.col("e.dense").alias("dense"),
        )
    )
    rows = cut_lineage(placed)
    entries = rows.select("block", F.explode(F.arrays_zip("terms", "bm25", "dense")).alias("e"))
    bounds = entries.groupBy("block", F.col("e.terms").alias("term")).agg(
        F.max("e.bm25").alias("bm25"), F.max("e.dense").alias("dense"), F.count("*").alias("n")
    )
    return FusedIndex(rows, cut_lineage(bounds), bm25.item_ids, (bm25, tfidf), size)


def encoded_texts(index: FusedIndex, texts: DataFrame) -> DataFrame:
    """(query_text, term, qb, qd): the weights of a text's terms for both scores."""
    left, right = (r.encode_queries(part, texts) for part in index.encoders)
    zero = F.lit(0.0)
    both = left.select("query_text", "term", F.col("weight").alias("qb"), zero.alias("qd")).unionByName(
        right.select("query_text", "term", zero.alias("qb"), F.col("weight").alias("qd"))
    )
    return both.groupBy("query_text", "term").agg(F.sum("qb").alias("qb"), F.sum("qd").alias("qd"))


def _undominated(
    bm25: np.ndarray, dense: np.ndarray, k: int, least: tuple[float, float], weights: tuple[float, float]
) -> np.ndarray:
    """Rows that ``k`` others do not beat for sure; rows stand in order of their ids."""
    keep = np.ones(len(bm25), bool)
    if len(bm25) <= k:
        return keep
    # of rows with equal scores the first k
    order = np.lexsort((np.arange(len(bm25)), dense, bm25))
    new = np.r_[True, (np.diff(bm25[order]) != 0) | (np.diff(dense[order]) != 0)]
    starts = np.flatnonzero(new)
    keep[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k
    left, right = np.flatnonzero(keep), None
    if len(left) <= k:
        return keep
    tops = bm25.max() or 1.0, dense.max() or 1.0
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        mixed = share * bm25[left] / tops[0] + (1 - share) * dense[left] / tops[1]
        best = left[np.argpartition(mixed, len(left) - k)[len(left) - k :]]
        b, d = bm25[best].min(), dense[best].min()
        beaten = np.zeros(len(keep), bool)
        if weights[0] > 0:
            beaten |= (bm25 < b - least[0]) & (dense <= d)
        if weights[1] > 0:
            beaten |= (bm25 <= b) & (dense < d - least[1])
        keep &= ~beaten
    return keep


_FOUND = "bm25_score double, dense_score double, n long, least_bm25 double, least_dense double"


class _Block(TermBlock):
    """Postings of a block by term with both weights; items stand in order of their ids."""

    def __init__(self, held: pa.RecordBatch):
        super().__init__(held.take(pc.sort_indices(held.column(0))), (2, 3))

    def scores(self, asking: pa.RecordBatch):
        """(row, items hit, both scores of all items) for each asking row that hits any."""
        for row, rows, bm25, dense in self.sums(asking, ("qb", "qd")):
            yield row, np.unique(rows), bm25, dense


def _block_scores(k: int, weights: tuple[float, float]):
    """Task that adds up both scores of each query in a block and keeps what may be among the best."""

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        block = _Block(held)
        margins = [asking.column(f"_margin_{c}").to_numpy() for c in ("cap_bm25", "cap_dense")]
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for row, hit, bm25, dense in block.scores(asking):
            bm25, dense = bm25[hit], dense[hit]
            keep = _undominated(bm25, dense, k, (margins[0][row], margins[1][row]), weights)
            count = int(keep.sum())
            first = np.zeros(count, np.int64)
            first[0] = len(hit)
            columns = (np.full(count, row), hit[keep], bm25[keep], dense[keep], first)
            least = (np.full(count, bm25.min()), np.full(count, dense.min()))
            for column, values in zip(out, (*columns, *least)):
                column.append(values)
        if not out[0]:
            return
        flat = [np.concatenate(c) for c in out]
        arrays = [asking.column("query_text").take(pa.array(flat[0])), block.items.take(pa.array(flat[1]))]
        names = ["query_text", "item_id", "bm25_score", "dense_score", "n", "least_bm25", "least_dense"]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c) for c in flat[2:]]], names)

    return search


def _id_type(index: FusedIndex) -> str:
    return index.rows.schema["item_id"].dataType.simpleString()


def _listed(encoded: DataFrame) -> DataFrame:
    """One row per text with its terms and their weights."""
    entries = F.collect_list(F.struct("term", "qb", "qd")).alias("e")
    return encoded.groupBy("query_text").agg(entries).select(
        "query_text", F.col("e.term").alias("query_terms"), F.col("e.qb").alias("qb"), F.col("e.qd").alias("qd")
    )


def _read(index: FusedIndex, chosen: DataFrame, encoded: DataFrame, k: int, weights) -> DataFrame:
    """Rows of the chosen (query_text, block) pairs that may be among the best."""
    kind = _id_type(index)
    asking = chosen.join(_listed(encoded), "query_text").select(
        "block",
        "query_text",
        "query_terms",
        "qb",
        "qd",
        *[
            (F.lit(MARGIN) * F.col(cap) / F.lit(w) if w > 0 else F.lit(0.0)).alias(f"_margin_{cap}")
            for cap, w in zip(("cap_bm25", "cap_dense"), weights)
        ],
    )
    return streamed(
        index.rows, asking, ["block"], _block_scores(k, weights), f"query_text string, item_id {kind}, {_FOUND}"
    )


def _ratio(score: Column | str, most: Column | str) -> Column:
    score, most = (F.col(c) if isinstance(c, str) else c for c in (score, most))
    return F.when(most > 0, score / most).otherwise(F.lit(0.0))


@dataclass
class FusedSearch:
    """What a search of texts found: ``top`` lists, ``encoded`` texts, ``bounds`` per text and block.

    ``scale`` has the largest and least score of each kind per text, as the normalisation uses them.
    """

    top: DataFrame
    encoded: DataFrame
    bounds: DataFrame
    scale: DataFrame
    weights: tuple[float, float]


def fused_topk_texts(index: FusedIndex, texts: DataFrame, k: int = 50, **settings) -> DataFrame:
    """Best ``k`` matches per text: (query_text, item_id, score, bm25_score, dense_score, rank)."""
    return fused_search(index, texts, k, **settings).top


def fused_search(
    index: FusedIndex,
    texts: DataFrame,
    k: int = 50,
    bm25_weight: float = 0.5,
    dense_weight: float = 0.5,
    normalization: str = "minmax",
) -> FusedSearch:
    if normalization not in ("minmax", "none", "raw"):
        raise ValueError(f"unsupported normalization: {normalization}")
    if min(bm25_weight, dense_weight) < 0:
        raise ValueError("block bounds need weights of 0 or more")
    scaled = normalization == "minmax"
    weights = (bm25_weight, dense_weight)
    encoded = cut_lineage(encoded_texts(index, texts))
    small = skew.fits_broadcast(encoded)
    per_text = Window.partitionBy("query_text")
    joined = index.bounds.join(F.broadcast(encoded) if small else encoded, "term")
    bounds = (
        joined.groupBy("query_text", "block")
        .agg(
            F.sum(F.col("qb") * F.col("bm25")).alias("up_bm25"),
            F.sum(F.col("qd") * F.col("dense")).alias("up_dense"),
            F.sum("n").alias("_n"),
        )
        .withColumns(
            {
                "cap_bm25": F.max("up_bm25").over(per_text) if scaled else F.lit(1.0),
                "cap_dense": F.max("up_dense").over(per_text) if scaled else F.lit(1.0),
                # only a text that may match every item has minima above 0
                "whole": (F.sum("_n").over(per_text) >= index.size) & F.lit(scaled),
            }
        )
        .withColumn(
            "_up", _blend(weights, _ratio("up_bm25", "cap_bm25"), _ratio("up_dense", "cap_dense"))
        )
    )
    by_bound = per_text.orderBy(F.col("_up").desc(), "block")
    bounds = cut_lineage(
        bounds.withColumn("first", F.col("whole") | (F.row_number().over(by_bound) <= FIRST_BLOCKS))
    )
    found = cut_lineage(_read(index, bounds.where("first"), encoded, k, weights))
    later = bounds.where(~F.col("first"))
    if not later.isEmpty():
        found = found.unionByName(
            _read(index, _reachable(bounds, later, found, k, weights, scaled), encoded, k, weights)
        )
    stats = found.groupBy("query_text").agg(
        F.sum("n").alias("_n"),
        *[F.max(f"{s}_score").alias(f"_most_{s}") for s in ("bm25", "dense")],
        *[F.min(f"least_{s}").alias(f"_least_{s}") for s in ("bm25", "dense")],
    )
    lows = [
        F.when(F.col("_n") >= index.size, F.col(f"_least_{s}")).otherwise(F.lit(0.0)).alias(f"low_{s}")
        for s in ("bm25", "dense")
    ]
    spans = [(F.col(f"_most_{s}") - F.col(f"low_{s}")).alias(f"span_{s}") for s in ("bm25", "dense")]
    scale = stats.select("*", *lows).select("query_text", "low_bm25", "low_dense", *spans)
    if not scaled:
        one, zero = F.lit(1.0), F.lit(0.0)
        scale = stats.select(
            "query_text", zero.alias("low_bm25"), zero.alias("low_dense"), one.alias("span_bm25"), one.alias("span_dense")
        )
    scored = found.join(scale, "query_text").select(
        "query_text",
        "item_id",
        "bm25_score",
        "dense_score",
        F.round(
            _blend(
                weights,
                *[_ratio(F.col(f"{s}_score") - F.col(f"low_{s}"), f"span_{s}") for s in ("bm25", "dense")],
            ),
            r.SCORE_DIGITS,
        ).alias("score"),
    )
    top = r.best_first("query_text", "score", k, scored.where("score > 0"))
    return FusedSearch(top, encoded, bounds, scale, weights)


KINDS = ("bm25", "dense", "hybrid")
#: Up to this many items of a text are sent past all blocks; those of other texts stay in their own block.
RANKED_AT_ONCE = 1024
#: Items of a block in the order of ids.
ID_BLOCK_ITEMS = 16384


def _all_scores(row: int, bm25: np.ndarray, dense: np.ndarray, asking: pa.RecordBatch, weights):
    """The three scores of a block's items for one asking row."""
    mixed = np.zeros(len(bm25))
    matched = (bm25 > 0) | (dense > 0)
    for values, name, weight in zip((bm25, dense), ("bm25", "dense"), weights):
        low, span = (asking.column(f"{what}_{name}")[row].as_py() for what in ("low", "span"))
        if span > 0:
            mixed[matched] += weight * ((values[matched] - low) / span)
    return bm25, dense, np.round(mixed, r.SCORE_DIGITS)


def _wanted_scores(weights: tuple[float, float]):
    """Task that gives the scores of the asked items of a block."""

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        block = _Block(held)
        ids = np.array(block.items.to_pylist())
        rows, places, scores = [], [], []
        for row, _, bm25, dense in block.scores(asking):
            at = np.searchsorted(ids, np.array(asking.column("wanted")[row].as_py()))
            rows.append(np.full(len(at), row))
            places.append(at)
            scores.append(np.stack([x[at] for x in _all_scores(row, bm25, dense, asking, weights)]))
        if rows:
            arrays = [
                asking.column("query_text").take(pa.array(np.concatenate(rows))),
                block.items.take(pa.array(np.concatenate(places))),
                *[pa.array(x) for x in np.concatenate(scores, axis=1)],
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["query_text", "item_id", *[f"{k}_score" for k in KINDS]])

    return search


def _before(scores: np.ndarray, own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of a block's matches stand before each asked item; items stand in order of ids.

    Behind all matches an item without a score stands at its place among the rest, so its count is
    that of the matches at later places.
    """
    hit = np.flatnonzero(scores > 0)
    values, codes = np.unique(-scores[hit], return_inverse=True)
    width = len(scores) + 1
    keys = np.sort(codes * width + hit)
    at = np.searchsorted(values, -own)
    equal = np.zeros(len(own), bool)
    inside = at < len(values)
    equal[inside] = values[at[inside]] == -own[inside]
    ahead = np.searchsorted(keys, at * width + np.where(equal, places, 0))
    return np.where(own > 0, ahead, len(hit) - np.searchsorted(hit, places))


def _counts_before(weights: tuple[float, float]):
    """Task that counts the matches of a block before the asked items."""

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        block = _Block(held)
        ids = np.array(block.items.to_pylist())
        rows, counts, wanted = [], [], []
        for row, _, bm25, dense in block.scores(asking):
            names = asking.column("wanted")[row].values
            places = np.searchsorted(ids, np.array(names.to_pylist()))
            three = _all_scores(row, bm25, dense, asking, weights)
            own = [asking.column(f"{k}_score")[row].values.to_numpy() for k in KINDS]
            counts.append(np.stack([_before(x, o, places) for x, o in zip(three, own)]))
            rows.append(np.full(len(places), row))
            wanted.append(names)
        if rows:
            arrays = [
                asking.column("query_text").take(pa.array(np.concatenate(rows))),
                pa.concat_arrays(wanted),
                *[pa.array(x) for x in np.concatenate(counts, axis=1)],
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["query_text", "item_id", *KINDS])

    return search


def _ties_and_counts(scores: np.ndarray, own: np.ndarray, places: np.ndarray):
    """What a block tells of one score: distinct values of its matches with their counts, at last 0 with the
    number of matches, and for each asked item how many matches of the same score stand before it.

    For an item without a score these are the matches at later places, as in ``_before``.
    """
    hit = np.flatnonzero(scores > 0)
    values, codes, counts = np.unique(-scores[hit], return_inverse=True, return_counts=True)
    width = len(scores) + 1
    keys = np.sort(codes * width + hit)
    at = np.searchsorted(values, -own)
    ties = np.searchsorted(keys, at * width + places) - np.searchsorted(keys, at * width)
    ties = np.where(own > 0, ties, len(hit) - np.searchsorted(hit, places))
    return np.append(-values, 0.0), np.append(counts, len(hit)), ties


def _tied_scores(weights: tuple[float, float]):
    """Task that gives, per text, the scores of the asked items that lie in the block and how many matches of
    the block have each score."""
    names = ["query_text", "item_id", "block", *[f"{k}_score" for k in KINDS], *KINDS, "kind", "score", "n"]

    def batch(texts, block, ids, scores, ties, kinds, values, counts) -> pa.RecordBatch:
        asked, rows = len(ids), len(texts)

        def behind(given, kind):
            return pa.concat_arrays([pa.array(given, kind), pa.nulls(rows - asked, kind)])

        def ahead(given, kind):
            return pa.concat_arrays([pa.nulls(asked, kind), pa.array(given, kind)])

        arrays = [
            pa.array(texts, pa.string()),
            pa.concat_arrays([ids, pa.nulls(rows - asked, ids.type)]),
            pa.array(np.full(rows, block), pa.int32()),
            *[behind(x, pa.float64()) for x in scores],
            *[behind(x, pa.int64()) for x in ties],
            ahead(kinds, pa.int32()),
            ahead(values, pa.float64()),
            ahead(counts, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, here) -> Iterator[pa.RecordBatch]:
        block = _Block(held)
        ids = np.array(block.items.to_pylist())
        zeros = np.zeros(len(ids))
        seen = iter(block.scores(asking))
        following = next(seen, None)
        for row in range(asking.num_rows):
            bm25 = dense = zeros
            if following is not None and following[0] == row:
                _, _, bm25, dense = following
                following = next(seen, None)
            asked = asking.column("wanted")[row].values
            asked = block.items[:0] if asked is None else asked
            places = np.searchsorted(ids, np.array(asked.to_pylist())) if len(asked) else np.zeros(0, int)
            three = _all_scores(row, bm25, dense, asking, weights)
            told = [_ties_and_counts(x, x[places], places) for x in three]
            kinds = np.repeat(np.arange(len(KINDS)), [len(values) for values, _, _ in told])
            texts = [asking.column("query_text")[row].as_py()] * (len(asked) + len(kinds))
            yield batch(
                texts, here[0], asked, [x[places] for x in three], [t for _, _, t in told], kinds,
                np.concatenate([v for v, _, _ in told]), np.concatenate([c for _, c, _ in told]),
            )

    return search


_SETTINGS = ["query_terms", "qb", "qd", "low_bm25", "low_dense", "span_bm25", "span_dense"]
_SCORES = [f"{k}_score" for k in KINDS]


def _counts_of_many(index: FusedIndex, search: FusedSearch, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Scores of ``wanted`` and how many matches stand before each, for texts with many wanted items.

    Blocks follow the ids, so every block but an item's own holds either earlier or later ids only: with
    the number of matches of each score per text and block the items need not leave their block.
    """
    kind = _id_type(index)
    blocks = max(1, -(-index.size // ID_BLOCK_ITEMS))
    lists = ("terms", "bm25", "dense")
    # items without any term have a place of their own, too
    named = index.item_ids.select("item_id").where("item_id is not null").distinct()
    rows = cut_lineage(
        named.join(index.rows.select("item_id", *lists), "item_id", "left")
        .withColumns({c: F.coalesce(c, F.array().cast(index.rows.schema[c].dataType)) for c in lists})
        .repartitionByRange(blocks, "item_id")
        .withColumn("block", F.spark_partition_id())
        .select("block", "item_id", *lists)
    )
    held = skew.join(wanted, rows.select("item_id", "block"), "item_id", keys_from=wanted)
    listed = held.groupBy("query_text", "block").agg(F.collect_list("item_id").alias("wanted"))
    every = texts.crossJoin(F.broadcast(rows.select("block").distinct()))
    asking = every.join(listed, ["query_text", "block"], "left").select("block", "query_text", "wanted", *_SETTINGS)
    told = streamed(
        rows, asking, ["block"], _tied_scores(search.weights),
        f"query_text string, item_id {kind}, block int, {', '.join(f'{n} double' for n in _SCORES)}, "
        f"{', '.join(f'{k} long' for k in KINDS)}, kind int, score double, n long",
    )
    told = cut_lineage(told)
    order = Window.partitionBy("query_text", "kind").orderBy(F.col("score").desc(), "block")
    whole = Window.partitionBy("query_text", "kind")
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    matches = F.sum(F.when(F.col("score") > 0, F.col("n")).otherwise(0)).over(whole)
    # the rows of score 0 follow all others; an item without a score needs the matches of later blocks
    ahead = F.when(F.col("score") > 0, F.col("_earlier")).otherwise(
        2 * F.col("_matches") - F.col("_earlier") - F.col("n")
    )
    before = (
        told.where("item_id is null")
        .withColumns({"_earlier": earlier, "_matches": matches})
        .select("query_text", "block", "kind", "score", ahead.alias("_ahead"))
    )
    own = told.where("item_id is not null")
    of_kind = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.greatest(F.col(f"{k}_score"), F.lit(0.0)).alias("score"), F.col(k).alias("ties"))
            for i, k in enumerate(KINDS)
        ]
    )
    each = own.select("query_text", "item_id", "block", *_SCORES, F.inline(of_kind))
    return (
        each.join(before, ["query_text", "block", "kind", "score"])
        .groupBy("query_text", "item_id")
        .agg(
            *[F.first(n).alias(n) for n in _SCORES],
            *[F.max(F.when(F.col("kind") == i, F.col("_ahead") + F.col("ties"))).alias(k) for i, k in enumerate(KINDS)],
        )
    )


def _counts_of_few(index: FusedIndex, search: FusedSearch, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for texts with few wanted items, whose scores stream past the blocks that share a term."""
    schema = f"query_text string, item_id {_id_type(index)}"
    held = skew.join(wanted, index.rows.select("item_id", "block"), "item_id", keys_from=wanted)
    in_blocks = held.groupBy("query_text", "block").agg(F.collect_list("item_id").alias("wanted"))
    asking = in_blocks.join(texts, "query_text").select("block", "query_text", "wanted", *_SETTINGS)
    found = streamed(
        index.rows, asking, ["block"], _wanted_scores(search.weights),
        f"{schema}, {', '.join(f'{n} double' for n in _SCORES)}",
    )
    scored = cut_lineage(
        wanted.join(found, ["query_text", "item_id"], "left").na.fill({n: 0.0 for n in _SCORES})
    )
    entry = F.collect_list(F.struct("item_id", *_SCORES)).alias("e")
    grouped = scored.groupBy("query_text").agg(entry).select(
        "query_text", F.col("e.item_id").alias("wanted"), *[F.col(f"e.{n}").alias(n) for n in _SCORES]
    )
    asking = (
        grouped.join(search.bounds.select("query_text", "block"), "query_text")
        .join(texts, "query_text")
        .select("block", "query_text", "wanted", *_SCORES, *_SETTINGS)
    )
    counted = streamed(
        index.rows, asking, ["block"], _counts_before(search.weights),
        f"{schema}, {', '.join(f'{k} long' for k in KINDS)}",
    )
    before = counted.groupBy("query_text", "item_id").agg(*[F.sum(k).alias(k) for k in KINDS])
    return scored.join(before, ["query_text", "item_id"], "left")


def catalog_ranks(index: FusedIndex, search: FusedSearch, wanted: DataFrame, places: DataFrame) -> DataFrame:
    """Scores and ranks in the whole catalog of ``wanted`` (query_text, item_id) pairs.

    A rank is counted, not looked up: each block tells how many of its items come before. No pair but
    the wanted ones leaves its task. ``places`` (item_id, item_idx) numbers the catalog from 1.
    """
    texts = _listed(search.encoded).join(search.scale, "query_text")
    sizes = wanted.groupBy("query_text").agg(F.count("*").alias("_n"))
    many = cut_lineage(sizes.where(F.col("_n") > RANKED_AT_ONCE).join(texts, "query_text").drop("_n"))
    if many.isEmpty():
        counted = _counts_of_few(index, search, wanted, texts)
    else:
        keys = many.select("query_text")
        few = _counts_of_few(index, search, wanted.join(keys, "query_text", "left_anti"), texts)
        counted = few.unionByName(_counts_of_many(index, search, wanted.join(keys, "query_text", "left_semi"), many))
    out = skew.join(counted, places, "item_id", keys_from=wanted)
    ranks = [
        (F.coalesce(k, F.lit(0)) + F.when(F.col(f"{k}_score") > 0, F.lit(1)).otherwise(F.col("item_idx")))
        .cast("long")
        .alias(f"{k}_rank")
        for k in KINDS
    ]
    return out.select("query_text", "item_id", *_SCORES, *ranks)


def _blend(weights: tuple[float, float], bm25: Column, dense: Column) -> Column:
    return F.lit(weights[0]) * bm25 + F.lit(weights[1]) * dense


def _reachable(
    bounds: DataFrame, later: DataFrame, found: DataFrame, k: int, weights: tuple[float, float], scaled: bool
) -> DataFrame:
    """Blocks not read yet that may raise a maximum or hold one of the best ``k``."""
    most = found.groupBy("query_text").agg(
        F.max("bm25_score").alias("_most_bm25"), F.max("dense_score").alias("_most_dense")
    )
    if scaled:
        # the k-th score of what is known, if the maxima were as large as the caps
        caps = bounds.select("query_text", "cap_bm25", "cap_dense").distinct()
        known = found.join(caps, "query_text")
        low = _blend(weights, _ratio("bm25_score", "cap_bm25"), _ratio("dense_score", "cap_dense"))
        up = _blend(weights, _ratio("up_bm25", "_most_bm25"), _ratio("up_dense", "_most_dense"))
    else:
        known, low = found, _blend(weights, F.col("bm25_score"), F.col("dense_score"))
        up = _blend(weights, F.col("up_bm25"), F.col("up_dense"))
    order = Window.partitionBy("query_text").orderBy(F.col("_low").desc())
    bar = (
        known.withColumn("_low", low)
        .withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") == k)
        .select("query_text", F.col("_low").alias("_bar"))
    )
    joined = later.join(most, "query_text", "left").join(bar, "query_text", "left")
    able = F.col("_bar").isNull() | (up >= F.col("_bar") - MARGIN)
    if scaled:
        able = able | (F.col("up_bm25") > F.col("_most_bm25")) | (F.col("up_dense") > F.col("_most_dense"))
    return joined.where(able).select(later["*"])


def hybrid_topk(
    index: FusedIndex,
    queries: DataFrame,
    k: int = 50,
    bm25_weight: float = 0.5,
    dense_weight: float = 0.5,
    normalization: str = "minmax",
) -> DataFrame:
    """Ranked items per query; lists shorter than ``k`` are completed by unmatched ids with score 0."""
    texts = cut_lineage(r.distinct_texts(queries))
    top = cut_lineage(fused_search(index, texts, k, bm25_weight, dense_weight, normalization).top)
    columns = ["score", "bm25_score", "dense_score"]
    filled = r.fill_with_zeros(top, texts, index.item_ids, k, columns)
    return r.to_queries(filled, queries.select("query_id", "query_text"))
