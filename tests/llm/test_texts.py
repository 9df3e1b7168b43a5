"""Token files, merge pieces and the shingle join on small tables, against plain Python."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from aisle.llm import pieces, shingle_join, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, ids string, n long, part string"
ODD = [
    None, "", " ", "a b c", "a b c", "  two  spaces \n\n and\ttabs ", "▁ literal ▁▁", "é 漢字 😀 ü\vz\x00",
    "x" * 3000, "wort " * 4000, "it's <|endoftext|> don't  ", " \n x", "nb sp a",
]


def table(spark, texts, ids=None):
    ids = range(1, len(texts) + 1) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", 0, "clash") for i, t in zip(ids, texts)], SCHEMA)


def test_token_files_hold_the_tokenizers_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    keys = [None, 40, 30, 30, 20, *range(1, len(ODD) - 4)]
    docs = table(spark, ODD, keys)
    out = str(tmp_path / "t")
    token_files.write_token_files(docs, out, path)
    got = token_files.token_summary(spark, out).orderBy("start").collect()
    want = {}
    for key, text in zip(keys, ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted(keys, key=lambda k: -1 if k is None else k)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    one = token_files.read_tokens(spark, out, (20, 20)).collect()
    assert [r.ids for r in one] == [tokenizer.encode(ODD[4], add_special_tokens=False).ids + [2]]


def test_token_files_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = table(spark, ["some words to read"] * 300)
    out = tmp_path / "t"
    token_files.write_token_files(docs, str(out), public_tokenizers.path("byte_bpe_50k.json"))
    for f in out.glob("*.parquet"):
        columns = {c["path_in_schema"]: c for c in (pq.ParquetFile(f).metadata.row_group(0).column(i).to_dict() for i in range(5))}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"]["encodings"])
        assert "DELTA_BINARY_PACKED" in columns["doc_id"]["encodings"]
    plan = token_files.read_counts(spark, str(out))._jdf.queryExecution().toString()
    assert "ids" not in plan[plan.index("ReadSchema") :]


def test_no_dropout_is_the_plain_encoding(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world, this is a test.", "der Hund und die Katze\nneue Zeile", "  two  spaces", "é 漢字 😀"]
    got = {r.doc_id: r.ids for r in pieces.encode_documents(table(spark, texts), path, dropout=0.0).collect()}
    assert got == {i + 1: model.encode(t) for i, t in enumerate(texts)}


def test_dropout_varies_and_decodes(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, ODD, [None, None, *range(2, len(ODD))])
    rows = pieces.round_trips(docs, path).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    again = pieces.round_trips(docs.repartition(5), path).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    text = "the quick brown fox jumps over the lazy dog and runs away from everything"
    cuts = {
        tuple(r.ids) for seed in (1, 2) for r in pieces.encode_documents(table(spark, [text] * 40), path, seed=seed).collect()
    }
    assert len(cuts) > 4


def test_heap_and_matrix_cut_alike(monkeypatch):
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.2, 3)
    words = ["internationalization", "abcabcabc", "aaaaaaaa", "grüße", "x"] + [str(i) * 3 for i in range(50)]
    matrix = model._encode_units(1, words)
    monkeypatch.setattr(pieces, "WIDEST", 1)
    assert model._encode_units(1, words) == matrix


def brute(texts, ids, ngram=4, percent=85):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        width = min(ngram, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((str(k), len(s), str(low.get(find(i)))) for i, (k, s) in enumerate(zip(ids, sets)))


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts = list(ODD[:10])
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 40, 90]))]
        for _ in range(rng.choice([1, 2, 6])):
            changed = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed))
    texts += [" ".join([word() for _ in range(rng.choice([8, 30]))] + shared) for _ in range(25)]
    big = [word() for _ in range(120)]
    for _ in range(30):
        copy = list(big)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy).upper())
    texts += texts[15:20]
    return texts


@pytest.mark.parametrize("frequent_rows,rounds", [(64, 3), (4, 2), (1, 0)])
def test_shingle_join_equals_brute_force(spark, frequent_rows, rounds):
    texts = corpus()
    ids = [None, *range(500, 499 + len(texts))]
    random.Random(1).shuffle(ids)
    got = shingle_join.near_duplicates(table(spark, texts, ids), frequent_rows=frequent_rows, rounds=rounds)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(texts, ids)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(("Some words\nand " + "x" * 50 + "  more ").encode() * 9, np.uint8)
    whole = shingle_join.word_hashes(data)
    monkeypatch.setattr(shingle_join, "PIECE_BYTES", 16)
    shingle_join._TABLES.clear()
    assert (shingle_join.word_hashes(data) == whole).all() and len(whole) == 9 * 5
    shingle_join._TABLES.clear()


@pytest.mark.parametrize("copies", [20, 40])
def test_near_copies_are_compared_with_few_others(spark, monkeypatch, copies):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[: 4 * i], f"new{i}", *words[4 * i + 1 :]]) for i in range(copies)]
    compared, verified = [], shingle_join._verified

    def counting(pairs, sets, percent):
        compared.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(shingle_join, "_verified", counting)
    ids = list(range(copies))
    got = shingle_join.near_duplicates(table(spark, texts, ids))
    assert {r.component_id for r in got.collect()} == {0}
    assert 0 < sum(compared) <= 2 * copies


def test_one_per_group_and_empty_tables(spark):
    texts = ["a b c d e f", "A b c d e f", None, "", "x"]
    docs = table(spark, texts)
    kept = shingle_join.one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    none = table(spark, [])
    assert shingle_join.near_duplicates(none).count() == 0
    assert pieces.round_trips(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
