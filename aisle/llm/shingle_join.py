"""Near duplicates by a blocked sparse product of documents and word n-grams.

The incidence matrix has a row per distinct set of n-grams (documents with equal sets are one class)
and a column per n-gram. Two sets can only reach the similarity if they share a column among each
one's first columns in a common order, rare ones first; the size of a set tells how many. Spark
shuffles these incidences by column, so that each task multiplies blocks of columns, and adds the
products up per pair. A pair whose sum, with all that sizes leave possible, stays below the overlap
its sizes call for is discarded, as is one whose bitmaps differ in more bits than its sizes allow; the others are compared
on their whole sets.

Columns with many rows (passages that thousands of documents share, groups of near copies) are put
last in the order. Where they are needed all the same, rows are first compared with some heads of the
column and linked, again and again while that leaves fewer to meet, and only rows of different
components are multiplied after that.

Of many pairs to compare, each set is first compared with one partner. Pairs whose ends are then in one
component need no comparison, so a group of near copies costs about as many as it has rows.

Incidences carry a column, a set and its size alone; bitmaps join the pairs that the sizes and sums
leave.

N-grams are held as 64-bit hashes and sets as the 128 bits of two sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm import arrow
from aisle.llm.common import BROADCAST_ROWS, by_size, is_small, materialise

NGRAM = 4
PERCENT = 85
#: A column with more rows than this counts as frequent.
FREQUENT = 64
#: Rounds in which frequent columns are looked for and put last.
ROUNDS = 1
#: Rows of frequent columns are compared with heads of the column as long as a row of them meets more
#: others than this on average and the last comparison found more than a pair per so many of these rows.
STAR_PARTNERS = 256
STAR_ROWS = 200
#: Heads of a column and size band, and about how many columns of a row are looked at in each turn.
HEADS = 8
STAR_COLUMNS = 8
#: Sets with more partners than this on average are compared with one partner first, as long as one in
#: so many of these comparisons is a link.
PARTNERS = 2
PARTNER_LINKS = 4
#: Up to this size bitmaps tell most unlike sets apart.
MAPPED_SIZE = 1200
PIECE_BYTES = 1 << 21
#: 64-bit words of a set's bitmap.
MAP_WORDS = 8
MAP = [f"bits{k}" for k in range(MAP_WORDS)]

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES, 1 << (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = (_powers(_BASE, size + 1), _powers(_UNBASE, size + 1))
    return _TABLES[size]


def _hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word of the bytes, A-Z lower-cased, and its place.

    A word's bytes are weighed by powers of an odd base, summed as a difference of running sums and
    divided by the first power, all modulo 2**64.
    """
    found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(data):
        stop = min(start + PIECE_BYTES, len(data))
        if stop < len(data):
            spaces = np.flatnonzero(_SPACES[data[start:stop]])
            if len(spaces):
                stop = start + int(spaces[-1]) + 1
            else:
                later = np.flatnonzero(_SPACES[data[stop:]])
                stop = stop + int(later[0]) + 1 if len(later) else len(data)
        part = data[start:stop]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~_SPACES[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        power, unpower = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[part]] * power[: len(part)], out=sums[1:])
        value = (sums[ends] - sums[begins]) * unpower[begins]
        found.append(_mix(value + (ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        places.append(begins + start)
        start = stop
    return np.concatenate(found), np.concatenate(places)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes alone."""
    return _hashed_words(data)[0]


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0xE7037ED1A0B428DB) + words[k : len(words) - width + 1 + k])
    return out


def shingle_sets(texts: list[str], ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams end to end, and where each text ends.

    A text of fewer words has one n-gram of all of them; one without words has none.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, places = _hashed_words(np.frombuffer(b"\n".join(encoded), np.uint8))
    sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    firsts = np.searchsorted(places, np.cumsum(sizes) - sizes)
    counts = np.diff(np.append(firsts, len(words)))
    out = np.zeros(len(words), np.uint64)
    if len(words) >= ngram:
        out[: len(words) - ngram + 1] = _grams(words, ngram)
    inside = np.ones(len(words), bool)
    for k in range(1, ngram):
        inside[(firsts + counts - k)[counts >= k]] = False
    for i in np.flatnonzero((counts > 0) & (counts < ngram)).tolist():
        at, n = int(firsts[i]), int(counts[i])
        out[at] = _grams(words[at : at + n], n)[0]
        inside[at] = True
    grams = out[inside]
    ends = np.concatenate([[0], np.cumsum(inside)])[firsts + counts]
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    for a, b in zip(starts.tolist(), ends.tolist()):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = grams[1:] != grams[:-1]
    keep[starts[starts < ends]] = True
    return grams[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _per_text(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (sums[ends] - sums[starts]).view(np.int64)


def signatures(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell the sets apart, independent of order."""
    one = _mix(grams ^ np.uint64(0x8EBC6AF09C88C6E3))
    two = _mix(grams + np.uint64(0x589965CC75374CC3))
    return _per_text(one, starts, ends), _per_text(two, starts, ends)


def parities(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the sets: each n-gram turns one bit, so two maps differ in no more bits than sets
    differ in n-grams."""
    bit = np.uint64(1) << ((grams >> np.uint64(8)) & np.uint64(63))
    word = grams & np.uint64(0xFF)
    filled = starts < ends
    maps = []
    for k in range(MAP_WORDS):
        bits = np.zeros(len(starts), np.uint64)
        if filled.any():
            turned = np.where(word % np.uint64(MAP_WORDS) == k, bit, np.uint64(0))
            bits[filled] = np.bitwise_xor.reduceat(turned, starts[filled])
        maps.append(bits.view(np.int64))
    return maps


def first_columns(grams: np.ndarray, last: np.ndarray | None, percent: int) -> np.ndarray:
    """The first columns of a set: rare before frequent (``last``), then by hash.

    A set of n needs an overlap of ceil(percent * n / 100) with any partner; so one of its first
    n - that + 1 columns is shared.
    """
    n = len(grams)
    count = n - (percent * n + 99) // 100 + 1 if n else 0
    if last is not None and last[:count].any():
        return np.concatenate([grams[~last], grams[last]])[:count]
    return grams[:count]


def _columns(docs: DataFrame, ngram: int, percent: int, frequent=None) -> DataFrame:
    """``doc_id, n, c1, c2, bits0.., columns`` of texts; with ``frequent`` only where it changes the
    columns."""
    names = ["doc_id", "n", "c1", "c2", *MAP]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in arrow.chunks(batches, "text"):
            grams, ends = shingle_sets(texts, ngram)
            starts = np.concatenate([[0], ends[:-1]])
            last = None
            if frequent is not None:
                known = frequent.value
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                last = known[at] == grams
            chosen, changed = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                mine = first_columns(grams[a:b], None if last is None else last[a:b], percent)
                differ = last is not None and not np.array_equal(np.sort(mine), grams[a : a + len(mine)])
                chosen.append(mine)
                changed.append(last is None or differ)
            offsets = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
            values = np.concatenate(chosen).view(np.int64)
            sides = [ends - starts, *signatures(grams, starts, ends), *parities(grams, starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).cast(pa.int64()),
                    *[pa.array(x, pa.int64()) for x in sides],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                [*names, "columns"],
            ).filter(pa.array(changed, pa.bool_()))

    return docs.mapInArrow(pick, ", ".join(f"{c} long" for c in names) + ", columns array<long>")


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in arrow.chunks(batches, "text", 1_000_000):
            grams, ends = shingle_sets(texts, ngram)
            starts = np.concatenate([[0], ends[:-1]])
            sets = [grams[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            c1, c2 = signatures(grams, starts, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c1), pa.array(c2), pa.array(sets, pa.binary())], ["c1", "c2", "grams"]
            ).filter(pa.array(ends > starts))

    return docs.mapInArrow(whole, "c1 long, c2 long, grams binary")


def _may_link(percent: int, a: str = "{}_a", b: str = "{}_b") -> Column:
    """Whether sizes and bitmaps of two sets leave the similarity possible.

    Sets that reach it differ in at most (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    one, two = F.col(a.format("n")), F.col(b.format("n"))
    differ = [F.bit_count(F.col(a.format(c)).bitwiseXOR(F.col(b.format(c)))) for c in MAP]
    total = reduce(Column.__add__, differ)
    return (F.least(one, two) * 100 >= F.greatest(one, two) * percent) & (
        total * (100 + percent) <= (one + two) * (100 - percent)
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                two = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                links.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(links, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("grams").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialise(both.mapInArrow(compare, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``cid, root`` of every end of a link: the smallest reachable one.

    Each round takes the smallest root among the neighbours and then the root's own root, so chains
    halve. Rounds go on until nothing changes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = materialise(both.toDF("cid", "other"), "edges")
    roots = materialise(
        both.groupBy("cid").agg(F.min("other").alias("low")).select("cid", F.least("cid", "low").alias("root")),
        "roots",
    )
    while True:
        near = (
            both.join(roots.select(F.col("cid").alias("other"), "root"), "other")
            .groupBy("cid")
            .agg(F.min("root").alias("near"))
        )
        lower = roots.join(near, "cid").select("cid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("cid").alias("root"), F.col("root").alias("next"))
        moved = lower.join(jump, "root", "left").select(
            "cid", "old", F.least("root", F.coalesce("next", "root")).alias("root")
        )
        moved = materialise(moved, "roots")
        roots = moved.select("cid", "root")
        if moved.where("root <> old").isEmpty():
            return roots


def _linked(roots: DataFrame | None, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components after the links among ``pairs``, added to the earlier ``roots``.

    Pairs whose ends an earlier link connects are not compared, as they change no component.
    """
    left, fruitful = pairs, True
    while True:
        total, ends = left.agg(F.count("*"), F.countDistinct("b")).first()
        every = not fruitful or total <= PARTNERS * ends
        tried = left if every else materialise(left.groupBy("b").agg(F.min("a").alias("a")), "tried")
        found = _verified(tried, sets, percent)
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():
            known = roots.select(F.col("cid").alias("a"), F.col("root").alias("b")).where("a <> b")
            roots = components(known.union(found))
        if every:
            return roots
        fruitful = found.count() * PARTNER_LINKS >= ends
        named = by_size(roots)
        for end in ("a", "b"):
            root = named.select(F.col("cid").alias(end), F.col("root").alias(f"root_{end}"))
            left = left.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        left = left.where("root_a <> root_b").select("a", "b").join(tried, ["a", "b"], "left_anti")
        left = materialise(left, "left")


def _classes(
    docs: DataFrame, signed: DataFrame, ngram: int, percent: int, frequent_rows: int, rounds: int
):
    """``c1, c2, cid`` of distinct sets, their ``cid, n, bits0..``, their first columns ``cid, n,
    columns``, and the columns that two or more of them share."""
    filled = signed.where("n > 0")
    classes = materialise(filled.groupBy("c1", "c2").agg(F.min("cid").alias("cid")), "classes")
    named = by_size(classes)
    kept = filled.drop("c1", "c2").join(by_size(classes.select("cid")), "cid")
    first = columns = kept.select("cid", "n", "columns")
    known = np.zeros(0, np.uint64)
    for turn in range(rounds + 1):
        shared = materialise(
            columns.select(F.explode("columns").alias("h"))
            .groupBy("h")
            .agg(F.count("*").alias("m"))
            .where("m > 1"),
            "columns",
        )
        frequent = shared.where(F.col("m") > frequent_rows).select("h")
        # the order only decides how much work there is; a list too long to send stays as it is
        if turn == rounds or frequent.isEmpty() or not is_small(frequent, 2 * BROADCAST_ROWS):
            break
        new = np.array([r.h for r in frequent.toLocalIterator()], np.int64).view(np.uint64)
        joined = np.union1d(known, new)
        if len(joined) == len(known) or len(joined) > 2 * BROADCAST_ROWS:
            break
        known = joined
        sent = docs.sparkSession.sparkContext.broadcast(known)
        again = _columns(docs, ngram, percent, sent).select("c1", "c2", "n", "columns")
        again = again.dropDuplicates(["c1", "c2"]).join(named, ["c1", "c2"])
        again = materialise(again.select("cid", "n", "columns"), "again")
        columns = first.join(by_size(again.select("cid")), "cid", "left_anti").unionByName(again)
    return classes, kept.select("cid", "n", *MAP), columns, shared


def _similar_in_size(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _mapped(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bitmaps leave the similarity possible."""
    one, two = (
        maps.select(F.col("cid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", *MAP)])
        for end in ("a", "b")
    )
    return pairs.join(one, "a").join(two, "b").where(_may_link(percent)).select("a", "b")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Adds up a pair's products and discards it if its sizes rule it out.

    Shared columns behind the earlier end of both firsts are at most ceil(percent * n / 100) - 1 of
    the larger set; frequent columns that were not multiplied here may all be shared.
    """
    need = F.expr(f"(({percent} * (n_a + n_b)) + {99 + percent}) div {100 + percent}")
    behind = F.expr(f"(({percent} * greatest(n_a, n_b)) + 99) div 100 - 1")
    return (
        pairs.groupBy("a", "b", "n_a", "n_b", "held_a", "held_b")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") + F.least("held_a", "held_b") + behind >= need)
        .select("a", "b")
    )


def _side(rows: DataFrame, end: str) -> DataFrame:
    names = {"cid": end} | {c: f"{c}_{end}" for c in ("n", "held", "root", *MAP)}
    return rows.select("h", *[F.col(c).alias(names[c]) for c in rows.columns if c in names])


def _mixed(many: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the frequent columns whose rows are in different components."""
    labelled = many.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = labelled.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    return materialise(labelled.join(mixed.select("h"), "h"), "open")


def _met(rows: DataFrame) -> tuple[int, int]:
    """How many rows of other components the rows meet in their columns, and the number of rows."""
    sizes = rows.groupBy("h", "root").agg(F.count("*").alias("m")).groupBy("h")
    sizes = sizes.agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
    met = sizes.agg(F.sum(F.col("all") * F.col("all") - F.col("same")).alias("met"), F.sum("all").alias("n")).first()
    return met.met or 0, met.n or 0


def _stars(rows: DataFrame, star: int, percent: int) -> DataFrame:
    """Pairs of rows and heads of some of their columns, in their own or the next smaller band.

    Heads go by a hash that differs from star to star. Those of small sets also differ from column to
    column, so a row meets many, and their bitmaps decide. Large sets meet one head in all columns,
    and a pair that met in fewer than half of the columns it would have to share is left out. These
    pairs only save work later; what is left out here comes back in the full product.
    """
    small = F.col("n") <= MAPPED_SIZE
    lead = F.xxhash64(F.lit(star), F.when(small, F.col("h")).otherwise(0), "cid")
    lead = F.struct(lead.alias("lead"), "cid", "n", "root", *MAP)
    group = F.when(small, F.pmod(F.xxhash64("cid", F.lit(star)), F.lit(HEADS))).otherwise(0)
    heads = rows.groupBy("h", "band", group.alias("group")).agg(F.min(lead).alias("head"))
    heads = by_size(materialise(heads, "heads"), BROADCAST_ROWS // 8)
    turn = F.pmod(F.xxhash64(F.lit(star), "h"), F.lit(1000)) * F.col("held") < 1000 * STAR_COLUMNS
    looked = rows.where(~small | turn)
    met = []
    for step in (0, 1):
        near = heads.select("h", (F.col("band") + step).alias("band"), "head")
        met.append(
            looked.join(near, ["h", "band"])
            .where(F.col("root") != F.col("head.root"))
            .where(_may_link(percent, "{}", "head.{}"))
            .select(
                F.least("cid", "head.cid").alias("a"),
                F.greatest("cid", "head.cid").alias("b"),
                F.greatest("n", "head.n").alias("most"),
                (F.col("n") + F.col("head.n")).alias("total"),
            )
        )
    share = F.expr(
        f"({percent} * total + {99 + percent}) div {100 + percent} - ({percent} * most + 99) div 100 + 1"
    )
    return (
        met[0].union(met[1]).groupBy("a", "b", "most", "total").agg(F.count("*").alias("shared"))
        .where((F.col("most") <= MAPPED_SIZE) | (F.col("shared") * 2 >= share))
        .select("a", "b")
    )


def class_roots(
    docs: DataFrame, signed: DataFrame, ngram: int, percent: int, frequent_rows: int, rounds: int
) -> DataFrame:
    """``c1, c2, cid, root`` of all distinct sets."""
    classes, maps, columns, shared = _classes(docs, signed, ngram, percent, frequent_rows, rounds)
    # merged at every size, as the list of shared columns grows with the input
    rows = columns.select("cid", "n", F.explode("columns").alias("h")).join(shared.hint("merge"), "h")
    rows = materialise(rows, "incidence")
    often = F.col("m") > frequent_rows
    held = materialise(rows.where(often).groupBy("cid").agg(F.count("*").alias("held")), "held")
    rows = rows.join(by_size(held), "cid", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    few, many = rows.where(~often), rows.where(often)

    # products of columns with few rows
    products = _side(few, "a").join(_side(few, "b"), "h").where(
        (F.col("a") < F.col("b")) & _similar_in_size(percent)
    )
    pairs = materialise(_mapped(_bounded(products, percent), maps, percent), "pairs")

    # in the others each row meets heads of about its size, other ones each time
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))))
    many = many.select("h", "cid", "n", "held", band.alias("band")).join(maps.drop("n"), "cid")
    many = materialise(many, "frequent")
    involved = pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))
    involved = involved.union(many.select("cid")).distinct()
    wanted = materialise(classes.join(involved, "cid"), "involved")
    sets = materialise(
        _sets(docs, ngram).join(by_size(wanted), ["c1", "c2"]).dropDuplicates(["cid"]).select("cid", "grams"),
        "sets",
    )
    roots = _linked(None, pairs, sets, percent)
    open_rows = _mixed(many, roots)
    star, last = 0, None
    while True:
        met, count = _met(open_rows)
        if met <= STAR_PARTNERS * count or (last is not None and last * STAR_ROWS <= count):
            break
        tried = _stars(open_rows, star, percent).join(pairs, ["a", "b"], "left_anti")
        tried = materialise(tried, "stars")
        pairs = materialise(pairs.union(tried), "pairs")
        roots = _linked(roots, tried, sets, percent)
        open_rows = _mixed(many, roots)
        star, last = star + 1, tried.count()

    # rows of one frequent column that are still in different components
    if not open_rows.isEmpty():
        products = _side(open_rows, "a").join(_side(open_rows, "b"), "h").where(
            (F.col("a") < F.col("b"))
            & (F.col("root_a") != F.col("root_b"))
            & _may_link(percent)
        )
        # rare columns were multiplied before; at most all rare first columns are shared
        rare = F.expr(f"n_a - (({percent} * n_a) + 99) div 100 + 1 - held_a")
        more = F.expr(f"n_b - (({percent} * n_b) + 99) div 100 + 1 - held_b")
        products = products.withColumns({"held_a": rare, "held_b": more})
        rest = _bounded(products, percent).join(pairs, ["a", "b"], "left_anti")
        roots = _linked(roots, materialise(rest, "rest"), sets, percent)
    return classes.join(roots, "cid", "left").select("c1", "c2", F.coalesce("root", "cid").alias("root"))


def near_duplicates(
    docs: DataFrame,
    ngram: int = NGRAM,
    percent: int = PERCENT,
    frequent_rows: int = FREQUENT,
    rounds: int = ROUNDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when their n-gram sets have a Jaccard similarity of ``percent`` or more; the
    component is the smallest id that links reach. Null, empty and blank texts have no n-grams and
    stand alone, texts of fewer words have one; null ids keep a null component when alone; repeated
    rows link like copies. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = _columns(rows, ngram, percent).withColumn("cid", F.monotonically_increasing_id())
    signed = materialise(signed, "signed")
    roots = class_roots(rows, signed, ngram, percent, frequent_rows, rounds)
    lows = signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("low"))
    lows = materialise(lows.join(roots, ["c1", "c2"]), "lows")
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    named = lows.join(least, "root").select("c1", "c2", "component_id")
    return signed.join(named, ["c1", "c2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_per_group(
    docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text"
) -> DataFrame:
    """One document of each component, with all columns."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, ngram, percent, doc_id="_row", text=text)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"))
    dropped = materialise(others, "dropped")
    return numbered.join(by_size(dropped), "_row", "left_anti").select(*docs.columns)
