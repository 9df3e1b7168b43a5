"""Token ids as Parquet list columns in document order, read back by column.

Rows are sorted into ranges of ids, encoded batch by batch and written one file per range. Ids are
dictionary encoded, document ids and counts delta encoded; row groups and pages are small enough
for readers to fetch some documents by the page index, and counts are read without the ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aisle.llm import arrow as lists
from aisle.llm.common import before_parts, shuffle_parts

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
CACHE_UNITS = 200_000
CACHED_CHARS = 48

#: A space after anything but white space always starts a new token of the byte-level pattern.
_UNIT = re.compile(r"(?<=\S) ")
_BEHIND = re.compile(r"\s ")
_TAILS = (",", ".")
#: Units met lately and those of the generation before, which move on when met again.
_ENCODERS: dict[str, tuple[object, np.ndarray, dict[str, dict[str, bytes]]]] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        # a byte-level token has one character for each of its bytes
        sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            sizes[i] = len(token)
        _ENCODERS[path] = (tokenizer, sizes, {"new": {}, "old": {}})
    return _ENCODERS[path]


def _encode(tokenizer, texts: list[str]) -> list[bytes]:
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [array("i", e.ids).tobytes() for e in found]


def _encode_units(tokenizer, sizes: np.ndarray, units: list[str]) -> dict[str, bytes]:
    """Ids of each unit with the space before it.

    A space behind anything but white space starts a token, so units that do not end in white space
    are encoded end to end in one call; the bytes that the ids stand for tell where each one ends.
    """
    last = [u for u in units if not u or u[-1].isspace()]
    rest = [u for u in units if u and not u[-1].isspace()]
    found = dict(zip(last, _encode(tokenizer, [" " + u for u in last])))
    if rest:
        ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(rest)], add_special_tokens=False)[0].ids, "<i4")
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in rest), np.int64, len(rest)))
        cuts = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
        data = ids.tobytes()
        starts = [0, *(4 * cuts[:-1]).tolist()]
        found.update((u, data[a:b]) for u, a, b in zip(rest, starts, (4 * cuts).tolist()))
    return found


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    Texts are cut where the tokenizer's own pattern always cuts, and each distinct unit is encoded
    once, which gives the ids of the whole text.
    """
    tokenizer, sizes, kept = _encoder(path)
    if len(kept["new"]) > CACHE_UNITS:
        kept["old"], kept["new"] = kept["new"], {}
    cache, old = kept["new"], kept["old"]
    split = []
    heads = []
    for text in texts:
        # a plain split does where no space stands at the start or behind other white space
        plain = not text.startswith(" ") and _BEHIND.search(text) is None
        units = text.split(" ") if plain else _UNIT.split(text)
        heads.append(units[0])
        del units[0]
        split.append(units)
    units_here = set().union(*split)
    cache.update((u, old[u]) for u in units_here.difference(cache).intersection(old))
    missing = list(units_here.difference(cache))
    # a comma or full stop behind a letter or digit is always a token of its own
    ended = [u for u in missing if u[-1:] in _TAILS and u[-2:-1].isalnum()]
    needed = list({*missing, *(u[:-1] for u in ended)}.difference(cache).difference(ended))
    cache.update(_encode_units(tokenizer, sizes, needed))
    tails = dict(zip(_TAILS, _encode(tokenizer, list(_TAILS))))
    cache.update((u, cache[u[:-1]] + tails[u[-1]]) for u in ended)
    starts = _encode(tokenizer, heads)
    ids = [a + b"".join(map(cache.__getitem__, units)) for a, units in zip(starts, split)]
    for u in {*missing, *needed}:
        if len(u) > CACHED_CHARS:
            del cache[u]
    return ids


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``part, place, doc_id, n_tokens, ids`` in ascending order of ids inside ascending parts."""
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in lists.chunks(batches, "text"):
            rows = [ids + end for ids in encode_texts(texts, tokenizer)]
            counts = pa.array([len(r) // 4 for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), piece.column(2), counts, lists.int_lists(rows)],
                ["part", "place", "doc_id", "n_tokens", "ids"],
            )

    order = ["doc_id", "_tie"]
    ranges = (
        docs.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_parts(docs), *order)
        .sortWithinPartitions(*order)
        .select(
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
            "doc_id",
            "text",
        )
    )
    return ranges.mapInArrow(
        encode, "part int, place long, doc_id long, n_tokens long, ids array<int>"
    )


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encodes whole texts and writes the token files.

    Null texts count as empty and have the end id alone; null ids come first; of equal ids the order
    is that of a hash of the text; an empty table writes a file without rows. Other columns of
    ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    delta = ("part", "place", "doc_id", "n_tokens")
    writer = encoded(rows, tokenizer, end_id).write.option("compression", "zstd")
    writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer = writer.option("parquet.page.size", str(page_bytes))
    writer = writer.option("parquet.page.row.count.limit", "1000")
    for name in delta:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``part, place, doc_id, n_tokens``; the ids are not read."""
    return spark.read.parquet(path).select("part", "place", "doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, ids: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``, of a range of document ids if given (pages outside are skipped)."""
    rows = spark.read.parquet(path)
    if ids is not None:
        rows = rows.where(F.col("doc_id").between(*ids))
    return rows.select("doc_id", "n_tokens", "ids")


def token_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` adds the counts of all earlier parts to those of earlier places in the same part.
    """

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = lists.list_bytes(batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(3)],
                    pa.array([len(r) // 4 for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                ],
                ["part", "place", "doc_id", "n_tokens", "ids_crc32"],
            )

    totals = read_counts(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    starts = before_parts(totals.withColumnRenamed("part", "_part"))
    sums = spark.read.parquet(path).select("part", "place", "doc_id", "ids").mapInArrow(
        checksum, "part int, place long, doc_id long, n_tokens long, ids_crc32 long"
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(starts), F.col("part") == F.col("_part"))
        .select(
            "doc_id",
            (F.col("_before") + F.col("_inside")).cast("long").alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
