"""SentencePiece merge encoding with seeded merge-dropout, and lossless decoding.

A text is cut into units at spaces, where no piece of a merge vocabulary reaches across. Inside a
unit, candidate merges wait in an agenda ordered by score and place; a keyed hash of the seed, the
unit, the place and the merged piece decides whether a candidate is skipped, so the same document
is always cut alike and other seeds or variants cut it differently. Distinct units of a batch go
through the agenda together as rows of one matrix, and units that were met before are looked up.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm import arrow

DROPOUT = 0.1
SEED = 1
#: Documents are dealt into so many ways of cutting the same unit.
VARIANTS = 4
CACHE_UNITS = 150_000
WIDEST = 48
MATRIX_ROWS = 4096
CHUNK_CHARS = 1_500_000
DECODED_ROWS = 500
FOREIGN = 1 << 20
NEVER = np.int32(2**31 - 1)
SPACE = "▁"

_UNIT = re.compile(r"(?<=[^ ]) ")
_MODELS: dict[tuple, Pieces] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A merge vocabulary with its agenda."""

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [
            i for i in range(len(names))
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches across a space; units can't be encoded on their own")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "<i4")
        self.data: list[bytes] = [b""] * len(names)
        for i in plain:
            self.data[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.data[i] = bytes([b])
        ids = {names[i]: i for i in plain}
        self.symbols = np.arange(FOREIGN, FOREIGN + 0x110000, dtype=np.int32)
        for name, i in ids.items():
            if len(name) == 1 and name != SPACE:
                self.symbols[ord(name)] = i
        if SPACE in ids:
            self.symbols[ord(" ")] = ids[SPACE]
        rank = {s: k for k, s in enumerate(sorted({-model.get_score(i) for i in plain}))}
        keys, merged, order = [], [], []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = ids.get(name[:cut]), ids.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
                    order.append(rank[-model.get_score(i)])
        by_key = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[by_key]
        self.merged = np.array(merged, np.int32)[by_key]
        self.order = np.array(order, np.int32)[by_key]
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.seed = np.uint64(zlib.crc32(str(seed).encode()) << 32)
        self.caches: dict[int, dict[str, bytes]] = {}

    def candidates(self, left, right, place, unit):
        """Rank and piece of each pair; ``NEVER`` where nothing merges or the hash skips it."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.merged[at]
        mark = unit + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drop = _mix(_mix(mark ^ self.seed) + piece.astype(np.uint64)) < self.limit
        ok = (self.keys[at] == key) & ~drop
        return np.where(ok, self.order[at], NEVER), piece

    def _matrix(self, symbols: np.ndarray, lengths: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Runs the agenda of all rows; returns which cells of ``symbols`` are left."""
        rows, width = symbols.shape
        places = np.arange(width)
        left = places < lengths[:, None]
        after = np.tile(places + 1, (rows, 1))
        before = np.tile(places - 1, (rows, 1))
        waiting = np.full((rows, width), NEVER)
        piece = np.zeros((rows, width), np.int32)
        r, c = np.nonzero(places[:-1] < lengths[:, None] - 1) if width > 1 else ([], [])
        if len(r):
            waiting[r, c], piece[r, c] = self.candidates(symbols[r, c], symbols[r, c + 1], c, unit[r])
        active = np.arange(rows)
        while len(active):
            best = waiting[active].argmin(axis=1)
            some = waiting[active, best] < NEVER
            active, c = active[some], best[some]
            if not len(active):
                break
            gone = after[active, c]
            symbols[active, c] = piece[active, c]
            left[active, gone] = False
            waiting[active, gone] = NEVER
            waiting[active, c] = NEVER
            nxt = after[active, gone]
            after[active, c] = nxt
            has = nxt < lengths[active]
            a, p, n = active[has], c[has], nxt[has]
            before[a, n] = p
            waiting[a, p], piece[a, p] = self.candidates(symbols[a, p], symbols[a, n], p, unit[a])
            prev = before[active, c]
            has = prev >= 0
            a, p, n = active[has], prev[has], c[has]
            waiting[a, p], piece[a, p] = self.candidates(symbols[a, p], symbols[a, n], p, unit[a])
        return left

    def _alone(self, symbols: np.ndarray, unit: np.uint64) -> list[int]:
        """The same agenda as a heap, for one long unit."""
        size = len(symbols)
        syms, after, before = symbols.tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(ps, ns):
            lefts, rights = np.array([syms[p] for p in ps]), np.array([syms[n] for n in ns])
            found = self.candidates(lefts, rights, np.array(ps), np.full(len(ps), unit))
            for p, n, order, piece in zip(ps, ns, *map(np.ndarray.tolist, found)):
                if order < NEVER:
                    heapq.heappush(heap, (order, p, syms[p], syms[n], piece))

        if size > 1:
            offer(list(range(size - 1)), list(range(1, size)))
        while heap:
            _, p, a, b, piece = heapq.heappop(heap)
            n = after[p]
            if syms[p] != a or n >= size or syms[n] != b:
                continue
            syms[p], syms[n] = piece, -1
            after[p] = after[n]
            if after[p] < size:
                before[after[p]] = p
                offer([p], [after[p]])
            if before[p] >= 0:
                offer([before[p]], [p])
        return [s for s in syms if s >= 0]

    def _ids(self, symbols: list[int]) -> bytes:
        """Pieces as ids; what has no piece goes byte by byte."""
        out = []
        for s in symbols:
            if s >= FOREIGN:
                out.extend(self.byte_ids[list(chr(s - FOREIGN).encode("utf-8", "surrogatepass"))].tolist())
            else:
                out.append(s)
        return np.array(out, "<i4").tobytes()

    def _encode_units(self, variant: int, units: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        units = sorted(units, key=len)
        salt = np.uint64((variant + 1) * 0xD6E8FEB86659FD93 % 2**64)
        for start in range(0, len(units), MATRIX_ROWS):
            part = units[start : start + MATRIX_ROWS]
            flat = np.frombuffer((" " + " ".join(part)).encode("utf-32-le"), np.uint32)
            lengths = np.array([len(u) + 1 for u in part])
            ends = np.cumsum(lengths)
            symbols = self.symbols[flat]
            unit = np.array([zlib.crc32(u.encode()) for u in part], np.uint64) + salt
            short = lengths <= WIDEST
            n = int(short.sum())
            if n:
                width = int(lengths[n - 1])
                table = np.zeros((n, width), np.int32)
                inside = np.arange(width) < lengths[:n, None]
                table[inside] = symbols[: ends[n - 1]]
                left = self._matrix(table, lengths[:n], unit[:n])
                kept = table[left]
                stops = np.cumsum(left.sum(axis=1))
                data = memoryview(kept.astype("<i4").tobytes())
                foreign = (np.where(left, table, 0) >= FOREIGN).any(axis=1)
                begin = 0
                for u, stop, odd in zip(part[:n], stops.tolist(), foreign.tolist()):
                    found[u] = self._ids(kept[begin:stop].tolist()) if odd else bytes(data[4 * begin : 4 * stop])
                    begin = stop
            for k in range(n, len(part)):
                found[part[k]] = self._ids(self._alone(symbols[ends[k] - lengths[k] : ends[k]], unit[k]))
        return found

    def _known(self, variant: int, units: list[str]) -> list[bytes]:
        """Ids of distinct units; those met before are looked up."""
        if sum(map(len, self.caches.values())) > CACHE_UNITS:
            self.caches.clear()
        cache = self.caches.setdefault(variant, {})
        fresh = self._encode_units(variant, [u for u in units if u not in cache])
        cache.update((u, ids) for u, ids in fresh.items() if len(u) <= WIDEST)
        return [cache[u] if u in cache else fresh[u] for u in units]

    def _cut_alike(self, variant: int, texts: list[str]) -> list[bytes]:
        def ids_of(cut: arrow.Units) -> list[bytes]:
            found = self._known(variant, cut.names.to_pylist())
            return arrow.joined(cut.codes, cut.ends, arrow.Pool.of(found))

        cut = arrow.space_units(texts)
        # a space at the start or behind another one does not cut
        inexact = cut.texts_with(pc.equal(cut.names, "").to_numpy(zero_copy_only=False))
        ids = ids_of(cut)
        again = np.flatnonzero(inexact).tolist()
        if again:
            for k, x in zip(again, ids_of(arrow.listed_units([_UNIT.split(texts[k]) for k in again]))):
                ids[k] = x
        return ids

    def encode(self, texts: list[str], variants: list[int]) -> list[bytes]:
        out = [b""] * len(texts)
        of: dict[int, list[int]] = {}
        for k, (text, variant) in enumerate(zip(texts, variants)):
            if text:
                of.setdefault(variant, []).append(k)
        for variant, rows in of.items():
            for k, ids in zip(rows, self._cut_alike(variant, [texts[k] for k in rows])):
                out[k] = ids
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.data.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return text.decode("utf-8", "surrogatepass")[1:]


def pieces(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Pieces:
    """The vocabulary of this process, loaded once."""
    key = (path, dropout, seed)
    if key not in _MODELS:
        _MODELS[key] = Pieces(path, dropout, seed)
    return _MODELS[key]


def encode_documents(
    docs: DataFrame,
    model: str,
    dropout: float = DROPOUT,
    seed: int = SEED,
    variants: int = VARIANTS,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, *keep, text_sha256, variant, ids, n_tokens, ids_crc32`` of every document.

    The variant comes from the seed and the id, the checksum from the ids as little-endian 32-bit
    integers. Null and empty texts have no ids; rows that repeat are cut alike; null ids are a
    variant too; an empty table gives an empty result. ``dropout`` 0 gives the plain merge encoding.
    Texts are not normalised, so decoding is lossless.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        *keep,
        F.sha2(body, 256).alias("text_sha256"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(variants)).cast("int").alias("variant"),
        body.alias("_text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model, dropout, seed)
        for piece, texts in arrow.chunks(batches, "_text", CHUNK_CHARS):
            at = piece.schema.get_field_index("variant")
            ids = coder.encode(texts, piece.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns[:-1],
                    arrow.int_lists(ids),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                [*piece.schema.names[:-1], "ids", "n_tokens", "ids_crc32"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encode, f"{schema}, ids array<int>, n_tokens long, ids_crc32 long")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (any table with ``ids``) with ``decoded``, the text of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                ids = arrow.list_bytes(part.column(part.schema.get_field_index("ids")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([coder.decode(x) for x in ids], pa.string())],
                    [*part.schema.names, "decoded"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(decode, f"{schema}, decoded string")


def round_trips(docs: DataFrame, model: str, **how) -> DataFrame:
    """``doc_id, variant, n_tokens, ids_crc32, round_trip``: whether decoding gave the text back."""
    decoded = decode_documents(encode_documents(docs, model, **how), model)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "variant", "n_tokens", "ids_crc32", same.alias("round_trip"))
