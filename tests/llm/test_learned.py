"""Toxic spans, private data, page wrappers and the pipeline on small tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aisle.llm import private_data, shingle_join, toxic_spans, wrappers
from aisle.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(1, 301):
        words = [word() for _ in range(rng.randrange(5, 120))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zounder", "Quibbler", "xanthip" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(None, "plain words"), (901, None), (902, ""), (903, "zounder " * 3000), (903, "zounder " * 3000)]
    labels += [(901, 1, None), (None, 1, 1), (1, 1, 0)]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_scores_hold_out_and_spans(insults):
    docs, labels = insults
    got = toxic_spans.score_documents(docs, labels).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id and r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[901].predicted and not by_id[902].predicted and by_id[903].predicted
    words = [text[r.doc_id][s.start : s.end].lower() for r in got for s in r.spans]
    named = sum(w.startswith(("zounder", "quibbler", "xanthip")) for w in words)
    assert len(words) > 3000 and named >= 0.98 * len(words)


def test_toxic_without_labels_or_rows(spark, insults):
    docs, labels = insults
    none = labels.where("false")
    assert toxic_spans.score_documents(docs, none).agg(F.sum("predicted")).first()[0] == 0
    assert toxic_spans.score_documents(docs.where("false"), labels).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    moves, lengths = rng.normal(size=(2, 2)), np.array([3, 0, 5, 1])
    scores = rng.normal(size=9) * 2
    odds = toxic_spans.marginals(scores, lengths, moves)
    start = 0
    for n in lengths:
        part, sums = scores[start : start + n], np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(part[i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                sums[i, y] += weight
        assert np.allclose(odds[start : start + n], np.log(sums[:, 1] / sums[:, 0]))
        start += n


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), place, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    bits = [
        "a.b@mail.example.com", "a@b.c_d@e.f", "x@@y.z", "12.3@x.com 1", "@a.b", "+1 (386) 555-3733", "+49-30.123456", "4111 1111 1111 1111",
        "4111111111111112", "4012888888881881", "25.86.162.211", "1.2.3.4.5", "256.1.1.1", "007.1.1.1", "3.", "é", "\n", " ", "word", "-", "12", "+",
    ]
    texts = [None, "", "1" * 9000, "1 " * 9000, "a" * 9000 + "@", "1." * 5000] + [
        rng.choice([" ", "", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(120)
    ]
    docs = docs_of(spark, [*enumerate(texts), (None, "a@b.c"), (0, None)])
    spans = private_data.private_spans(docs, trees=2)
    got = private_data.private_digest(spans).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = base_spans((texts[r.doc_id] if r.doc_id is not None else "a@b.c") or "")
        listed = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (texts[r.doc_id or 0], r.spans, listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert not set(listed.split(",")) - set(r.spans.split(","))
    assert private_data.private_digest(private_data.private_spans(docs.where("false"))).count() == 0


def test_boosting_adds_confident_spans(spark):
    rng = random.Random(9)
    number = lambda: f"{rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"call +1 ({number()} or {rng.randrange(2000)} now") for i in range(400)] + [(1000, f"or 1 ({number()} or 17")]
    got = private_data.private_spans(docs_of(spark, rows)).where("not base").collect()
    assert {r.doc_id for r in got} == {1000} and {r.kind for r in got} == {"phone"}


def test_national_and_spelled_forms_are_added(spark):
    rng = random.Random(5)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows, want = [], {}
    for i in range(400):
        parts = ["+1 " + number(), f"ann{i}@mail{i}.example.com", f"part {rng.randrange(10**4, 10**7)}"]
        if i % 5 == 0:
            parts.append(number())
            want[i] = [("phone", parts[-1])]
        elif i % 5 == 1:
            parts.append(f"bob{i} [at] mail{i} [dot] example [dot] com")
            want[i] = [("email", parts[-1])]
        rng.shuffle(parts)
        rows.append((i, " ; or ".join(parts)))
    text, got = dict(rows), {}
    for r in private_data.private_spans(docs_of(spark, rows)).where("not base").collect():
        got.setdefault(r.doc_id, []).append((r.kind, text[r.doc_id][r.start : r.end]))
    assert got == want


def test_redaction(spark):
    docs = spark.createDataFrame([(0, 5, "mail a@b.cd or +49 30 1234567."), (1, 6, None)], "row long, doc_id long, text string")
    spans = spark.createDataFrame(
        [(0, 5, "email", 5, 11), (0, 5, "phone", 15, 29)], "row long, doc_id long, kind string, start long, end long"
    )
    assert {r.doc_id: r.text for r in private_data.redacted(docs, spans).collect()} == {5: "mail [email] or [phone].", 6: None}


def test_overlaps_with_base_spans_in_texts_of_many(spark):
    """The windows tell what comparing each candidate with each base span tells; many spans take seconds."""
    drawn = random.Random(5)
    parts = ["a.b@c.example", "x@y", "10.0.0.1", "1.2.3.4.5.6", "+49 30 1234 5678", "(386) 555-3733", "4111 1111 1111 1111", "me [at] host [dot] com", "and", "12 34 56"]
    rows = [(k, "".join(drawn.choice(parts) + drawn.choice([" ", "", ", "]) for _ in range(40))) for k in range(60)]
    found = private_data.candidates(docs_of(spark, rows).select(F.col("doc_id").cast("long").alias("row"), "doc_id", "text"))
    got = private_data.overlaps(found.where("kind is not null")).collect()
    base = [r for r in got if r.base]
    assert base and any(r.taken for r in got if not r.base) and not all(r.taken for r in got if not r.base)
    for r in (r for r in got if not r.base):
        mine = [b for b in base if b.row == r.row]
        assert r.taken == any(b.start < r.end and b.end > r.start for b in mine), r
        assert r._same == any(b.kind == r.kind and b.start >= r.start - 1 and b.end == r.end for b in mine), r
    many = docs_of(spark, [(1, " ".join(f"user{k}@host{k % 7}.example" for k in range(30_000)))])
    row = private_data.private_digest(private_data.private_spans(many, trees=2)).first()
    assert row.n_email == 30_000 and row.spans.count(",") == 29_999


def page(k, body, side=""):
    return (
        f"<!DOCTYPE html><html><head><title>t{k}</title><script>var t='</p>';</script></head><body><nav><ul>"
        + "".join(f"<li><a href='/{j}'>m{j}</a></li>" for j in range(2 + k % 3))
        + f"</ul></nav><div class=\"ad\">buy {k}</div>{side}{body}<div class='comments'><p>first!</p></div><footer>&copy; x</footer></body></html>"
    )


def test_wrappers_read_main_text(spark):
    rows, want = [], {}
    for k in range(12):
        text = [f"Title {k}", f"One &amp; {'two ' * (k + 40)}\n three {k}", f"last {k * 7}"]
        plain = "\n".join(["Title %d" % k, " ".join(f"One & {'two ' * (k + 40)} three {k}".split()), f"last {k * 7}"])
        blocks = f"<h1>{text[0]}</h1><p><b>{text[1]}<br><p>{text[2]}</p>"
        rows.append((k, f"http://a.example/{k}", page(k, f"<article>{blocks}</article>")))
        rows.append((100 + k, f"https://B.example/{k}", page(k, f"<div id='c{'' }'><div class='story'>{blocks}<div class='more'>Read more here</div></div></div>", "<aside>side</aside>" * (k % 2))))
        want[k] = want[100 + k] = plain
    rows += [(900, "http://a.example/x", None), (901, None, ""), (902, "nonsense", "no tags &lt;here"), (903, "http://a.example/y", "<p>loose" * 3)]
    want.update({900: "", 901: "", 902: "no tags <here", 903: "loose\nloose\nloose"})
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = wrappers.main_texts(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.main_texts(pages.where("false")).count() == 0


def texts_of(spark, pages):
    rows = [(k, "http://w.example/" + str(k), html) for k, html in enumerate(pages)]
    got = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [t for _, t in sorted((r.page_id, r.text) for r in got)]


def test_names_of_pages_and_articles_do_not_remove_text(spark):
    story = lambda k: f"<h1>Title {k}</h1><p>{'word ' * (30 + k)}end {k}</p><figure><img><figcaption>seen {k}</figcaption></figure>"
    want = [f"Title {k}\n{'word ' * (30 + k)}end {k}\nseen {k}" for k in range(6)]
    for body, mark in (("has-sidebar", "post has-comments"), ("header-fixed", "share-price"), ("menu", "related")):
        got = texts_of(spark, [
            f"<html><body class='{body}'><nav><a>m{k}</a></nav><article class='{mark}'>{story(k)}"
            f"<div class='comments'><p>first {k}</p></div></article><footer>f</footer></body></html>"
            for k in range(6)
        ])
        assert got == want, (body, mark)


def test_groups_of_the_wrapper_decide_without_names(spark):
    menu = lambda k: "".join(f"<li><a href='/{j}'>go {j * k}</a></li>" for j in range(1 + k % 3))
    pages = [
        f"<body><div class='x'><h1>T{k}</h1><p>{'word ' * (30 + k)}</p><p>more {k}</p><ul class='y'>{menu(k)}</ul></div></body>"
        for k in range(8)
    ]
    assert texts_of(spark, pages) == [f"T{k}\n{('word ' * (30 + k)).strip()}\nmore {k}" for k in range(8)]


def test_wrappers_come_from_all_pages_of_a_host(spark):
    """A rare template has its wrapper, and a heading of some articles stays."""
    pages, want = [], []
    for k in range(150):
        text = [f"Title {k}", f"{'word ' * (40 + k % 7)}end {k}"]
        if k % 10 == 3:
            side = "".join(f"<div class='z'><a href='/{j}'>pick {j} {k}</a></div>" for j in range(3))
            pages.append(f"<body><div class='top'>{side}</div><div class='text'><h2>{text[0]}</h2><div>{text[1]}</div></div></body>")
        else:
            if k != 75:
                text.insert(1, "In short")
            heads = "<h3>In short</h3>" if k != 75 else ""
            pages.append(f"<body><article><h1>{text[0]}</h1>{heads}<p>{text[-1]}</p><h4>All rights kept</h4></article></body>")
        want.append("\n".join(text))
    assert texts_of(spark, pages) == want


def plain_match(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_match_is_a_longest_common_subsequence():
    drawn = random.Random(7)
    for _ in range(800):
        a, b = ([drawn.choice("abcde"[: drawn.randint(1, 5)]) for _ in range(drawn.randint(0, 40))] for _ in "ab")
        pairs = wrappers._match(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == plain_match(a, b)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_tokens_of_tags_that_never_end():
    assert list(wrappers.tokens("a<b c='>'>d< e<!x>f<!-- <i> -->g<script a>h<i></script >k<p 'l")) == [
        "a", "<b c='>'>", "d", "<", " e", "f", "g", "k", "<", "p 'l",
    ]
    for part in ("<a ", "<a \"<b '", "<!", "<script ", "<a b='"):
        page = part * (300_000 // len(part))
        assert "".join(wrappers.tokens(page)) == page, part


def test_deep_pages_keep_all_texts(spark):
    levels = 20_000
    deep = "".join(f"<div>at {k} <b>x</b>" for k in range(levels))
    tail = "".join("tail</div>" for _ in range(levels))
    aside = "<div>" * 500 + "kept<nav><div>go <i>away</i></div></nav>too" + "</div>" * 500
    inline = "".join(f"<i class='c{'abcdefgh'[k * k % 8]}'>w{k} " for k in range(levels))
    pages = [deep + tail, aside, "<p>" + inline, "<i>" * levels + "</p>" * levels + "end", "<div>" * 100_000]
    want = [
        "\n".join([*(f"at {k} x" for k in range(levels)), *["tail"] * levels]),
        "kept\ntoo",
        " ".join(f"w{k}" for k in range(levels)),
        "end",
        "",
    ]
    assert [wrappers.extract(p, []) for p in pages] == want
    assert texts_of(spark, pages)[1:2] == want[1:2]


def test_pages_of_many_mixed_elements(spark):
    drawn = random.Random(3)
    words = lambda: "".join(f"<{t}>w</{t}> {k} " for k, t in enumerate(drawn.choices(["b", "i", "u", "em", "code", "q"], k=8_000)))
    pages = [f"<body><article><p>{words()}</p></article></body>" for _ in range(2)]
    text = " ".join(f"w {k}" for k in range(8_000))
    assert texts_of(spark, pages) == [text, text]


def test_registry():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(n) for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark, insults, tmp_path):
    docs, labels = insults
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 200")
    again = plain.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)
    plain.union(again).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [now.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, now, str(tmp_path))
        assert k == 4 or found.columns == now.columns
        found.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        counts.append(now.count())
        if k == 2:
            groups = shingle_join.near_duplicates(now)
            assert groups.where("doc_id <> component_id").isEmpty()
            assert now.groupBy("text").count().where("count > 1").isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]


def test_pipeline_drops_near_copies_from_eighty_percent_of_five_words(spark):
    rows = []
    for k, n in enumerate((48, 49, 50, 51, 52)):
        words = [f"w{k}x{j}" for j in range(n)]
        rows.append((2 * k, " ".join(words)))
        words[n // 2] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    docs = docs_of(spark, rows)
    # one changed word leaves n - 9 of n + 1 five-word shingles and fewer than 85 percent of four words
    assert shingle_join.one_per_group(docs).count() == 10
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {0, 1} <= kept and len(kept) == 6
    assert all(len({2 * k, 2 * k + 1} & kept) == 1 for k in range(1, 5))
