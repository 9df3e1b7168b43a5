"""Mixing, block names, Hilbert shards and quality rules on small tables, against plain Python."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from aisle.llm import block_names, hilbert, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), "clash") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    long = "wort " * 5000 + "ende"
    return [
        (1, "a b c", "en", "x"), (2, "a b c", "en", "y"), (3, None, None, None), (4, "", "de", "x"),
        (None, "a b c", "en", "x"), (5, "  \n\t ", "en", "y"), (6, long, "de", "x"),
        (7, long, "de", None), (7, long, "de", None), (8, long + "!", "fr", "y"), (9, "é ü\vz", "fr", "z"),
    ]


def test_block_names_group_equal_texts_only(spark, odd_rows):
    weak = lambda block: F.pmod(F.xxhash64(block), F.lit(3))  # noqa: E731  most blocks share an index
    for size, index in ((64, F.xxhash64), (16_384, F.xxhash64), (64, weak)):
        got = block_names.exact_duplicates(docs_of(spark, odd_rows), size=size, index=index).collect()
        assert len(got) == len(odd_rows)
        groups = {}
        for i, text, *_ in odd_rows:
            groups.setdefault(text or "", []).append(i)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for sha, ids in by_sha.items():
            rows = [r for r in got if r.text_sha256 == sha]
            keep = max((i for i in ids if i is not None), default=None)
            assert [r.group_size for r in rows] == [len(ids)] * len(ids)
            assert {r.keep_id for r in rows} == {keep}
            assert [r.doc_id for r in rows if r.kept] == [keep]


def test_without_duplicates_keeps_columns(spark, odd_rows):
    docs = docs_of(spark, odd_rows).drop("_row")
    kept = block_names.without_duplicates(docs, size=64)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 8, 9]


def _level(sizes, weights, share):
    total, fixed, level = sum(sizes), set(), 0.0
    while total:
        rest = share * total - sum(2 * sizes[k] for k in fixed)
        free = sum(w for k, w in enumerate(weights) if k not in fixed)
        if not free:
            break
        level = rest / free
        over = {k for k in range(len(sizes)) if k not in fixed and 2 * sizes[k] < level * weights[k]}
        if not over:
            break
        fixed |= over
    return [min(2 * s, level * w) for s, w in zip(sizes, weights)]


def test_mixing_targets_and_cuts(spark):
    rows = [
        (i, " ".join(["w"] * (1 + i * 7 % 13)), "en", s)
        for i, s in enumerate(itertools.islice(itertools.cycle(["b", "a", "a", None, "c", "a"]), 600))
    ] + [(9000, None, None, "zz"), (9001, "  ", None, "zz")]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    source_of = {i: s for i, _, _, s in rows}
    order = ["a", "b", "c", "zz", None]
    words = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in order}
    targets = _level([words[s] for s in order], [5, 2, 1, 5, 2], 1.5)
    for s, want in zip(order, targets):
        mine = [r for r in got if source_of[r.doc_id] == s]
        assert {r.source_size for r in mine} == {words[s]}
        assert all(abs(r.target - want) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 13
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    again = mixing.mix_sources(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_is_nested_and_copies_rows(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "ab"[i % 2]) for i in range(200)]
    taken = {}
    for share in (0.5, 0.8):
        got = mixing.mix_sources(docs_of(spark, rows), share=share).collect()
        taken[share] = {r.doc_id for r in got if r.taken}
    assert taken[0.5] < taken[0.8]
    docs = docs_of(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs).collect()}
    assert counts == {k: v for k, v in want.items() if v}


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 1), (1, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        df = spark.createDataFrame(cells, ", ".join(f"c{i} long" for i in range(dims)))
        found = df.withColumn("k", hilbert.hilbert_index([F.col(c) for c in df.columns], bits)).collect()
        path = [tuple(r)[:-1] for r in sorted(found, key=lambda r: r.k)]
        assert sorted(r.k for r in found) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_hilbert_shards(spark, odd_rows):
    got = hilbert.hilbert_shards(docs_of(spark, odd_rows), shards=4).collect()
    assert len(got) == len(odd_rows)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    by_id = {i: t or "" for i, t, *_ in odd_rows}
    for r in got:
        data = by_id[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    # copies in one cell of the curve take neighbouring places
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(order.index(7) - (len(order) - 1 - order[::-1].index(7))) == 1


def test_written_shards_prune_in_every_dimension(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, "x" * (i * 37 % 500), "abcdefgh"[i % 8], "pqrstuvw"[i // 64 % 8]) for i in range(512)]
    docs = docs_of(spark, rows)
    hilbert.write_shards(docs, str(tmp_path / "s"), shards=16, bits=4)
    spans = []
    for f in (tmp_path / "s").glob("*.parquet"):
        table = pq.read_table(f).to_pylist()
        spans.append([(min(x), max(x)) for x in ([r[c] for r in table] for c in ("source", "lang", "n_chars"))])
    for dim, value in ((0, "r"), (1, "c"), (2, 250)):
        read = sum(low <= value <= high for low, high in (s[dim] for s in spans))
        assert read <= 0.75 * len(spans)


def test_quality_counts(spark, odd_rows):
    rows = odd_rows + [
        (20, "der Hund und die Katze\n" * 4 + "\n \n", "de", "x"),
        (21, "one two three four five six seven one two three four five nine ten", "en", "x"),
        (22, "sym### bols*** the%%% of$$$ and&&& to||| in<<< a>>> is### it***", "en", "x"),
        (23, "The cat and the dog went to the house of a friend that was in the town, and it was fun.", "en", "x"),
        (24, "a a a a a a b a a a a a a c d e f g h i j k l m n o p q r s t u v w x y z", "en", "x"),
    ]
    got = {r.doc_id: r for r in quality.quality_verdicts(docs_of(spark, rows)).collect()}
    for i, text, *_ in rows:
        text, r = text or "", got[i]
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(windows) < 500 else set(range(len(words) - 1))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered), i
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert got[23].kept and not got[22].kept and not got[20].kept


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert block_names.exact_duplicates(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert hilbert.hilbert_shards(empty).count() == 0
    assert quality.quality_verdicts(empty).count() == 0
