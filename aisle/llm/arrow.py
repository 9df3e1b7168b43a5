"""Arrow helpers of the tasks that encode and score texts batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 4_000_000


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, chars: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters each, and their texts; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        texts = ["" if t is None else t for t in column.to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def int_lists(rows: list[bytes]) -> pa.Array:
    """A list column from rows of little-endian 32-bit integers."""
    lengths = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    values = np.frombuffer(b"".join(rows), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_bytes(column: pa.Array) -> list[bytes]:
    """The rows of a list column of 32-bit integers as little-endian bytes; null is empty."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    data = memoryview(values.to_numpy(zero_copy_only=False).astype("<i4").tobytes())
    offsets = offsets - offsets[0]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [
        bytes(data[4 * a : 4 * b]) if ok else b""
        for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid)
    ]


class Units(NamedTuple):
    """Texts cut at every space: the distinct units, the unit of each place, where each text ends."""

    names: pa.Array
    codes: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])

    def texts_with(self, marked: np.ndarray) -> np.ndarray:
        """Texts that have one of the ``marked`` units before their last place."""
        hit = marked[self.codes]
        hit[self.ends - 1] = False
        sums = np.concatenate([[0], np.cumsum(hit)])
        return sums[self.ends] > sums[self.starts]


def space_units(texts: list[str]) -> Units:
    """Cuts texts at every space; an empty text is one empty unit."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    ends = parts.offsets.to_numpy()[1:].astype(np.int64)
    cut = parts.values.dictionary_encode()
    return Units(cut.dictionary, cut.indices.to_numpy().astype(np.int64), ends)


def listed_units(split: list[list[str]]) -> Units:
    """The same for texts that are cut already, each into one unit at least."""
    cut = pa.array([u for units in split for u in units], pa.large_string()).dictionary_encode()
    ends = np.cumsum([len(units) for units in split]).astype(np.int64)
    return Units(cut.dictionary, cut.indices.to_numpy().astype(np.int64), ends)


class Pool(NamedTuple):
    """The ids of several units end to end, and how many each has."""

    values: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, ids: list[bytes]) -> Pool:
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        return cls(np.frombuffer(b"".join(ids), "<i4"), sizes)


def joined(codes: np.ndarray, ends: np.ndarray, pool: Pool) -> list[bytes]:
    """The ids of each text: those of the units at its places, one after the other."""
    firsts = np.cumsum(pool.sizes) - pool.sizes
    counts = pool.sizes[codes]
    stops = np.cumsum(counts)
    at = np.arange(int(stops[-1]) if len(stops) else 0)
    at += np.repeat(firsts[codes] - (stops - counts), counts)
    data = memoryview(pool.values[at].tobytes())
    cuts = [0, *(4 * stops[ends - 1]).tolist()]
    return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
