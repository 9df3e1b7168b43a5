"""Benchmark passages in training texts, found with a generalised suffix automaton of the test items.

The normalised items of a benchmark are put into one automaton: a state for each set of word
sequences that end at the same places of the items. A task streams the words of its documents
through it and keeps the length of the longest match that ends at each word. Where that length
reaches ``window`` words, the last ``window`` words stand in an item; an item of fewer words counts
where the whole of it is matched. The items of a match are those whose places lie below its state in
the tree of suffix links, one slice of an array.

Items reach the tasks in groups of at most ``GROUP_WORDS`` words, one group after the other, so an
automaton has a bounded size however large the benchmark is. Items longer than a piece are cut into
pieces that overlap by ``window - 1`` words, which keeps every window whole. With one group the
documents are read once and nothing is shuffled; the spans of several groups are united per text.

Defined results: null and wordless texts have no words and no hits. Items without id, or without
words, take no part; items that share an id count once. Empty tables give no rows, or rows without
hits. Repeated documents are judged one by one alike. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.arrow import chunks
from aisle.llm.common import materialise, running

WINDOW = 10
GROUP_WORDS = 200_000
PIECE_WORDS = 10_000

#: A-Z to a-z, bytes that are in no word to a space. Bytes from 0x80 on always belong to words.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class SuffixAutomaton:
    """Automaton of several word sequences; ``close`` lays out the tree of suffix links."""

    def __init__(self, window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.size = [0]
        self.link = [-1]
        self.ends: list[tuple[int, int]] = []
        self.wholes: list[tuple[int, int, int]] = []

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """State for the part of ``to`` that is reached from ``at`` and its suffixes."""
        if self.size[to] == self.size[at] + 1:
            return to
        part = self._state(self.size[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = part
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = part
            at = self.link[at]
        return part

    def add(self, words: list[int], item: int) -> None:
        last = 0
        for word in words:
            known = self.step[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                at, last = last, self._state(self.size[last] + 1, {}, 0)
                while at >= 0 and word not in self.step[at]:
                    self.step[at][word] = last
                    at = self.link[at]
                if at >= 0:
                    self.link[last] = self._split(at, word, self.step[at][word])
            self.ends.append((last, item))
        if words and len(words) < self.window:
            self.wholes.append((last, len(words), item))

    def close(self) -> None:
        """Orders states so that those below a state form a slice, and points to what each one hits."""
        count = len(self.size)
        by_size = sorted(range(count), key=self.size.__getitem__)
        below = [1] * count
        for v in reversed(by_size[1:]):
            below[self.link[v]] += below[v]
        self.first = [0] * count
        free = [1] * count
        for v in by_size[1:]:
            up = self.link[v]
            self.first[v] = self.first[up] + free[up]
            free[up] += below[v]
        self.below = below
        marks = sorted((self.first[v], item) for v, item in self.ends)
        self.mark_at = np.array([m[0] for m in marks], np.int64)
        self.mark_item = np.array([m[1] for m in marks], np.int64)
        # the state of the last `window` words, and the nearest state that is a whole short item
        self.tail = list(range(count))
        self.short: dict[int, dict[int, list[int]]] = {}
        for v, words, item in self.wholes:
            self.short.setdefault(v, {}).setdefault(words, []).append(item)
        self.next_short = [-1] * count
        for v in by_size[1:]:
            up = self.link[v]
            if self.size[up] >= self.window:
                self.tail[v] = self.tail[up]
            self.next_short[v] = up if up in self.short else self.next_short[up]

    def items_of(self, state: int) -> np.ndarray:
        """Items in which the sequences of a state occur."""
        a, b = np.searchsorted(self.mark_at, (self.first[state], self.first[state] + self.below[state]))
        return np.unique(self.mark_item[a:b])

    def match(self, words: list[int], offset: int, spans: list, states: set, items: set) -> None:
        """Streams ``words``; adds hit spans (first, past the last), window states and short items."""
        step, size, link, tail = self.step, self.size, self.link, self.tail
        short, next_short, window = self.short, self.next_short, self.window
        at = length = 0
        for i, word in enumerate(words, offset + 1):
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                length = size[at]
                to = step[at].get(word)
            if to is None:
                continue
            at, length = to, length + 1
            if length >= window:
                states.add(tail[at])
                spans.append((i - window, i))
            if short:
                v = at if at in short else next_short[at]
                while v >= 0:
                    for m, found in short[v].items():
                        if m <= length:
                            spans.append((i - m, i))
                            items.update(found)
                    v = next_short[v]


class Group:
    """Automaton of one group of items with the numbers of its words and the ids of its items."""

    def __init__(self, rows: list[tuple[str, bool, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.automaton = SuffixAutomaton(window)
        number: dict[str, int] = {}
        self.shortest = window
        for item, whole, words in rows:
            own = number.setdefault(item, len(number))
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.automaton.add(codes, own)
            if whole:
                self.shortest = min(self.shortest, len(words))
        self.ids = list(number)
        self.automaton.close()
        self._cached: dict[int, np.ndarray] = {}

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """United hit spans of a document, and the ids of the items that it holds."""
        codes = np.fromiter(
            map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words)
        )
        # a word that no item has ends every match: only runs of known words are streamed
        known = np.flatnonzero(np.diff(np.concatenate([[0], codes >= 0, [0]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[int] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a >= self.shortest:
                self.automaton.match(codes[a:b].tolist(), a, spans, states, items)
        for state in states:
            if state not in self._cached:
                if len(self._cached) >= 10_000:
                    self._cached.clear()
                self._cached[state] = self.automaton.items_of(state)
            items.update(self._cached[state].tolist())
        return united(spans), sorted(self.ids[i] for i in items)


def united(spans) -> list[tuple[int, int]]:
    """Spans (first, past the last) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, spans array<struct<first:int,past:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def _searcher(shared, window: int):
    """Task that searches the texts of its batches for the items of one group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(pickle.loads(shared.value), window)
        for part, texts in chunks(batches, "_text"):
            sizes, spans, items = [], [], []
            for text in texts:
                words = word_list(text)
                hit, names = group.find(words)
                sizes.append(len(words))
                spans.append([{"first": a, "past": b} for a, b in hit])
                items.append(names)
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns += [
                pa.array(sizes, pa.int64()),
                pa.array(spans, _SPANS),
                pa.array(items, pa.list_(pa.string())),
            ]
            names = [*part.schema.names[:-1], "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return search


def _cutter(window: int, piece: int):
    """Task that cuts items into overlapping pieces of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            rows = []
            for item, text in zip(part.column(0).to_pylist(), texts):
                words = word_list(text)
                for place, start in enumerate(range(0, max(len(words) - window + 1, 1), piece)):
                    own = words[start : start + piece + window - 1]
                    if own:
                        rows.append((item, place, len(words) < window, len(own), b" ".join(own)))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "place", "whole", "size", "words"])

    return cut


def item_groups(
    benchmark: DataFrame, window: int, group_words: int, item: str = "item_id", text: str = "text"
) -> tuple[DataFrame, int]:
    """Pieces of the items, each with the number of its group of bounded size; and the number of groups."""
    named = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")
    )
    pieces = named.mapInArrow(
        _cutter(window, min(PIECE_WORDS, group_words)),
        "item string, place long, whole boolean, size long, words binary",
    )
    placed = running(pieces, ["item", "place", "words"], "size", "items", "before")
    grouped = materialise(
        placed.withColumn("group", F.floor(F.col("before") / group_words)).drop("before"), "item-groups"
    )
    last = grouped.agg(F.max("group")).first()[0]
    return grouped, 0 if last is None else last + 1


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``keep, n_words, spans, items`` of every row of ``docs``.

    ``spans`` are the hit words as united (first, past) places, ``items`` the ids of the items with
    an occurring window, sorted. Only a group's bounded words pass through the driver at a time.
    """
    spark = docs.sparkSession
    grouped, groups = item_groups(benchmark, window, group_words)
    body = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]
    body = body.toDF(*names, "_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body.schema.fields[:-1])
    if groups > 1:
        # a text that occurs several times is one row here, with its number
        body = body.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.sha1("_text")}).select(
            *names, "_h1", "_h2", "_text"
        )
        schema += ", _h1 long, _h2 string"
    found = None
    for number in range(max(groups, 1)):
        rows = grouped.where(F.col("group") == number).select("item", "whole", "words").collect()
        packed = [(r["item"], r["whole"], bytes(r["words"]).split()) for r in sorted(rows)]
        shared = spark.sparkContext.broadcast(pickle.dumps(packed))
        one = body.mapInArrow(_searcher(shared, window), f"{schema}, {FOUND}")
        found = one if found is None else found.unionByName(one)
    if groups > 1:
        found = _united_groups(found, [*names, "_h1", "_h2"], groups)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "n_words", "spans", "items")


def _united_groups(found: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """One row per row again after each of ``groups`` groups has been searched."""
    merged = found.groupBy(*keys, "n_words").agg(
        F.collect_set(F.when(F.size("spans") > 0, F.col("spans"))).alias("_spans"),
        F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("_items"),
        (F.count("*") / groups).cast("int").alias("_times"),
    )
    each = merged.select(
        *keys,
        "n_words",
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"),
        F.flatten("_spans").alias("spans"),
    )
    return each.mapInArrow(_unite, each.schema)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the spans of the last column."""
    for batch in batches:
        last = batch.num_columns - 1
        spans = [
            [{"first": a, "past": b} for a, b in united((s["first"], s["past"]) for s in row)]
            for row in batch.column(last).to_pylist()
        ]
        yield batch.set_column(last, "spans", pa.array(spans, _SPANS))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of words, hit words and items, a digest of the item ids, and the verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        *[c for c in found.columns if c not in ("spans", "items")],
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_NORMAL)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : starts[a]])
        done = ends[b - 1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def _cleaner(text_at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.schema.names[text_at]
            texts = batch.column(text_at).to_pylist()
            cuts = batch.column(batch.num_columns - 1).to_pylist()
            new = [
                t if not cut else _without(t, [(s["first"], s["past"]) for s in cut])
                for t, cut in zip(texts, cuts)
            ]
            out = batch.set_column(text_at, name, pa.array(new, batch.schema.field(text_at).type))
            yield out.select(out.schema.names[:-1])

    return clean


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    longest: int = 0,
    coverage: float = 0.5,
    text: str = "text",
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``docs`` with the hit spans of more than ``longest`` words cut out of their texts.

    Rows of whose words more than the share ``coverage`` is hit go altogether. The columns and their
    order are those of ``docs``.
    """
    at = docs.columns.index(text)
    own = tuple(f"_c{i}" for i in range(len(docs.columns)))
    plain = docs.toDF(*own)
    found = find_passages(plain, benchmark, window, own, own[at], group_words)
    size = F.aggregate("spans", F.lit(0), lambda n, s: n + s["past"] - s["first"])
    kept = found.where(size <= F.lit(coverage) * F.col("n_words")).select(
        *own, F.filter("spans", lambda s: s["past"] - s["first"] > longest).alias("_cut")
    )
    return kept.mapInArrow(_cleaner(at), plain.schema).toDF(*docs.columns)
