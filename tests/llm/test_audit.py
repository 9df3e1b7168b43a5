"""Negative mining, Merkle manifests and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from aisle.llm import decontaminate, merkle, negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, id long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, fanout=3):
    """Root and, for each leaf, its (left, right) siblings level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, place in enumerate(at):
            run, slot = runs[place // fanout], place % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at = [place // fanout for place in at]
        level = [H(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    trees = {}
    for i, text, lang, source, n, *_ in rows:
        tampered = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            tampered = text.replace("\n", "")
        leaf, seen = (H(*map(enc, (i, source, lang, n, t))) for t in (text, tampered))
        trees.setdefault(source, []).append(((i is not None, i or 0), leaf, seen, i))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        trees[name].sort()
        subs[name] = plain_tree([leaf for _, leaf, *_ in trees[name]])
    root, upper = plain_tree([subs[name][0] for name in names])
    out = []
    for name, above in zip(names, upper):
        for (_, leaf, seen, i), path in zip(trees[name], subs[name][1]):
            folded = seen
            for left, right in path + above:
                folded = H(left, folded, right)
            proof = H(*[left + right for left, right in path + above])
            out.append((i, leaf, subs[name][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def spark_manifest(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verified_rows(merkle.manifest(docs, seen={"text": seen}))
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, f"line {i}\nnext", "en", "hot", i, "x", 1, 2) for i in range(40)]
    rows += [(100 + i, None if i % 3 else "", None, f"s{i % 4}", None, "x", 1, 2) for i in range(9)]
    rows += [(7, "same", "en", "twice", 4, None, 1, 2)] * 5
    rows += [(None, "no id\n", "en", None, 5, "x", 1, 2), (500, "ä\n" * 20_000, "de", "lone", 9, "x", 1, 2)]
    got = spark_manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    lone = [(3, "a", "en", None, 1, "x", 1, 2)]
    assert spark_manifest(spark, lone) == plain_manifest(lone)
    assert spark_manifest(spark, []) == []


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_passages(text, items, window=10):
    words, hit, names = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        if item is None or not own:
            continue
        m = min(window, len(own))
        grams = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in grams:
                names.add(str(item))
                hit.update(range(i, i + m))
    return len(words), len(hit), len(names), H(",".join(sorted(names))), bool(hit)


def spark_passages(spark, docs, items, **options):
    left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    found = decontaminate.find_passages(left, right, **options)
    got = decontaminate.digest_columns(found).collect()
    names = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    return sorted((tuple(r[c] for c in names) for r in got), key=repr)


def test_passages_equal_plain_search(spark):
    dice = random.Random(5)
    letters = "a b c é Dd".split()

    def text(n):
        return "".join(dice.choice(letters) + dice.choice([" ", "-", "\n", ", "]) for _ in range(n))

    items = [(i, text(dice.choice([1, 2, 4, 7, 9, 10, 11, 15, 30]))) for i in range(3, 14)]
    items = [(i, "zz " + t if i % 2 else t) for i, t in items]
    items += [(3, text(12)), (20, None), (21, " .!"), (None, text(3)), (22, items[0][1])]
    docs = [(i, text(dice.choice([0, 1, 5, 20, 60]))) for i in range(40)]
    docs += [(41, "x y " + items[1][1] + " q " + items[4][1]), (42, None), (43, ""), (None, items[0][1])]
    docs += [(44, text(3_000)), (45, "zz " * 50), (45, "zz " * 50)]
    for window in (10, 5):
        for group_words in (200_000, 25):
            want = sorted(((i, *plain_passages(t, items, window)) for i, t in docs), key=repr)
            got = spark_passages(spark, docs, items, window=window, group_words=group_words)
            assert got == want, (window, group_words)


def test_passages_of_empty_tables(spark):
    assert spark_passages(spark, [(1, "a b")], []) == [(1, 2, 0, 0, H(""), False)]
    assert spark_passages(spark, [], [(1, "a b")]) == []


def test_decontaminated_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [
        (1, f"Vor dem Text: {item.upper()}! Dänach bleibt viel anderer Text stehen, der nicht im Test steht."),
        (2, item), (3, "ganz anderer Text"), (4, None),
    ]
    left = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, spans string")
    right = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(left, right)
    assert kept.columns == left.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {
        1: "Vor dem Text: ! Dänach bleibt viel anderer Text stehen, der nicht im Test steht.",
        3: "ganz anderer Text", 4: None,
    }
    whole = decontaminate.decontaminated(left, right, longest=12, coverage=1.0)
    assert {r.doc_id: r.text for r in whole.collect()} == dict(docs)


def plain_negatives(rows, anchors):
    shown = []
    for i, vector, label, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        shown.append((i, label, [math.floor(256 * x) for x in vector]))
    out = []
    for a, label, q in shown:
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), i, other) for i, other, r in shown if i != a]
        positives = sorted((s, i) for s, i, other in scored if other == label)[:5]
        for s, p in positives:
            inside = sorted((n, i) for n, i, other in scored if other != label and 50 * -s <= 100 * -n <= 95 * -s)
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(inside[:3], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score long, part string"


def spark_negatives(spark, rows, **options):
    items = spark.createDataFrame(rows, VECTORS)
    got = negatives.hard_negatives(items, F.col("id") % 3 == 0, **options)
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(tuple(r[c] for c in names) for r in got.collect())


def test_negatives_equal_plain_search(spark):
    dice = random.Random(3)
    rows = []
    for i in range(240):
        vector = [float(round(dice.gauss(0.2, 1), 2)) for _ in range(21)]
        rows.append((i, vector, dice.randrange(4), 1, "x"))
    rows += [(300 + i, [0.5] * 21, i % 4, 1, "x") for i in range(12)]
    rows += [(400, [0.0] * 21, 1, 1, "x"), (402, [0.1, None] + [0.0] * 19, 1, 1, "x"), (403, None, 1, 1, "x")]
    rows += [(405, [float("nan")] * 21, 1, 1, "x"), (408, [float("inf")] * 21, 1, 1, "x"), (None, [0.1] * 21, 1, 1, "x")]
    rows += [(411, [0.3] * 21, None, 1, "x"), (414, [0.4] * 5, 2, 1, None), (417, [], 2, 1, None), (420, [1.0] * 21, 9, 1, "x")]
    padded = [(i, v if v is None else v + [0.0] * (21 - len(v)), *rest) for i, v, *rest in rows]
    want = plain_negatives(padded, lambda i: i % 3 == 0)
    assert len(want) > 500
    for block_rows in (16_384, 40):
        assert spark_negatives(spark, rows, block_rows=block_rows) == want


def test_negatives_of_large_numbers_and_of_none(spark):
    rows = [(i, [1e6 * (i % 7 - 2), 3e6, -1e5 * i], i % 2, 1, "x") for i in range(30)]
    assert spark_negatives(spark, rows) == plain_negatives(rows, lambda i: i % 3 == 0)
    assert spark_negatives(spark, []) == []
    assert spark_negatives(spark, [(3, [0.1], 1, 1, "x")]) == []
