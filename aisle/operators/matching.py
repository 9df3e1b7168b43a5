"""Best matches of term lists: items stay in blocks with their postings, queries stream past them.

A block adds up the scores of its own items only and gives the best ``k`` of each query, so no table of
all pairs of query and item is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.scores import SCORE_DIGITS
from aisle.operators.vectors import first_k, streamed
from aisle.session import cut_lineage

BLOCK_ITEMS = 8192
LEAST_BLOCK = 512


class TermBlock:
    """Postings of a block by term; ``held`` has items, terms and weights in the order of places."""

    def __init__(self, held: pa.RecordBatch, weights: Sequence[int]):
        terms = held.column(1)
        bounds = terms.offsets.to_numpy()
        span = slice(bounds[0], bounds[-1])
        coded = terms.values[bounds[0] : bounds[-1]].dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.items = held.column(0)
        self.terms, self.codes = coded.dictionary, codes[order]
        self.rows = np.repeat(np.arange(held.num_rows), np.diff(bounds))[order]
        self.weights = [held.column(i).values.to_numpy()[span][order] for i in weights]

    def sums(self, asking: pa.RecordBatch, columns: Sequence[str]):
        """(row, places hit, scores of all items per weight) for each asking row that hits any."""
        lists = asking.column("query_terms")
        cuts = lists.offsets.to_numpy()
        wanted = pc.index_in(lists.values, value_set=self.terms)
        wanted = wanted.fill_null(-1).to_numpy(zero_copy_only=False)
        asked = [asking.column(c).values.to_numpy() for c in columns]
        for row in range(asking.num_rows):
            mine = slice(cuts[row], cuts[row + 1])
            firsts = np.searchsorted(self.codes, wanted[mine])
            sizes = np.searchsorted(self.codes, wanted[mine], "right") - firsts
            total = int(sizes.sum())
            if not total:
                continue
            at = np.arange(total) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
            rows, out = self.rows[at], []
            for q, w in zip(asked, self.weights):
                summed = np.bincount(rows, np.repeat(q[mine], sizes) * w[at], len(self.items))
                out.append(np.round(summed, SCORE_DIGITS))
            yield row, rows, *out


def _best_of_block(k: int, order: list[tuple[str, str]]):
    """Task that gives the best ``k`` positive scores of each query in a block, equal ones in ``order``."""

    def search(held: pa.RecordBatch, asking: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        block = TermBlock(held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_start")), [2])
        rows, places, scores = [], [], []
        for row, _, summed in block.sums(asking, ["query_weights"]):
            hit = np.flatnonzero(summed > 0)
            best = hit[first_k(summed[hit], k)]
            rows.append(np.full(len(best), row))
            places.append(best)
            scores.append(summed[best])
        if rows:
            arrays = [
                asking.column("_query").take(pa.array(np.concatenate(rows))),
                block.items.take(pa.array(np.concatenate(places))),
                pa.array(np.concatenate(scores)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["_query", "item_id", "score"])

    return search


def best_matches(
    postings: DataFrame,
    wanted: DataFrame,
    k: int,
    size: int,
    keys: Sequence[str] = (),
    tie: str | None = None,
) -> DataFrame:
    """The best ``k`` items per query by the sum of weight products: (keys, query_text, item_id, score, rank).

    ``postings`` (keys, item_id, term, weight) meet ``wanted`` (keys, query_text, term, weight) of the same
    keys. Only positive scores count; equal ones stand by ``tie`` down, a number that an item has in all of its
    postings, then by item id. ``size`` is about the number of items and decides the number of blocks.
    """
    names, more = list(keys), [tie] if tie else []
    cores = postings.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size // BLOCK_ITEMS), min(cores, size // LEAST_BLOCK))
    entries = F.collect_list(F.struct("term", "weight")).alias("e")
    held = (
        postings.where("weight is not null and term is not null")
        .groupBy(*names, "item_id", *more)
        .agg(entries)
        .select(
            F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"),
            *names,
            "item_id",
            F.col("e.term").alias("terms"),
            F.col("e.weight").alias("weights"),
            *more,
        )
    )
    listed = wanted.where("weight is not null").groupBy(*names, "query_text").agg(entries)
    # texts may be long, so a number stands for each until the lists are ready
    listed = cut_lineage(listed.withColumn("_query", F.monotonically_increasing_id()))
    asking = listed.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        *names,
        "_query",
        F.col("e.term").alias("query_terms"),
        F.col("e.weight").alias("query_weights"),
    )
    order = [(f"_{tie}", "descending")] if tie else []
    found = streamed(
        held,
        asking,
        ["block", *names],
        _best_of_block(k, [*order, ("_item_id", "ascending")]),
        f"_query long, item_id {postings.schema['item_id'].dataType.simpleString()}, score double",
        parts=skew.layout_parts(postings, 0),
    )
    down = [F.col("score").desc()]
    if tie:
        ties = postings.select(*names, "item_id", tie).distinct()
        queries = listed.select("_query", *names)
        found = found.join(queries, "_query").join(ties, [*names, "item_id"]).drop(*names)
        down.append(F.col(tie).desc())
    best = Window.partitionBy("_query").orderBy(*down, "item_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    top = cut_lineage(top.select("_query", "item_id", "score", "rank"))
    return top.join(listed.select("_query", *names, "query_text"), "_query").select(
        *names, "query_text", "item_id", "score", "rank"
    )
