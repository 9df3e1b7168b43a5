"""Known phrases by joins, and query fields and profiles read from model outputs."""

import json
import re
import time

from pyspark.sql import functions as F

from aisle.operators import phrases, profiles, queries as q


def flat(text):
    return re.sub(r"\s+", " ", text.strip().lower())


def plain_brand(text, brands):
    whole = flat(text)
    hits = [b for b in brands if flat(b) in whole and re.search(rf"\b{re.escape(flat(b))}\b", whole)]
    return min(hits) if hits else None


def plain_category(text, categories):
    whole, runs = flat(text), set(re.findall(r"\w+", flat(text)))
    hits = [
        c for c in categories
        if flat(c) and (flat(c) in whole or set(re.findall("[a-z0-9]+", flat(c))) - {"and"} & runs)
    ]
    return min(hits) if hits else None


def test_fifty_thousand_brands(spark):
    brands = [f"the maker {i}" for i in range(50_000)] + ["Über co", "AT&T", "c++", "&co", "new balance", "Balance", "x"]
    categories = ["art", "Toys and Games", "and", "R&D kits", "Ö", "ab", "outdoor cooking", " "]
    texts = [
        "the maker 777 smart lamp", "THE  maker 49999", "maker 12", "über co bag", "at&t phone", "c++ book", "x c++y", "a&co b",
        "new balance", "shoes by balance", "games", "and now", "r&d", "r&d kits", "öl", "crab", "", "outdoor  cooking set",
        "the maker 5 the maker 4", "cartoon", "xx", "x",
    ]
    items = spark.createDataFrame(
        [(b, categories[i % len(categories)]) for i, b in enumerate(brands)] + [(None, None)], "brand string, category string"
    )
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], None])], "id long, query_text string")
    got = {r["id"]: r for r in phrases.with_known(asked, items).collect()}
    assert len(got) == len(texts) + 2
    for i, text in enumerate(texts):
        assert got[i]["known_brand"] == plain_brand(text, brands), text
        assert got[i]["known_category"] == plain_category(text, categories), text
    assert got[len(texts)]["known_brand"] == "the maker 777" and got[len(texts) + 1]["known_brand"] is None


def test_shared_texts_stay_spread(spark, hot):
    items = spark.createDataFrame([("Nova", "Sports")], "brand string, category string")
    asked = spark.createDataFrame([(i, "nova sports") for i in range(50)], "id long, query_text string")
    out = phrases.with_known(asked, items)
    assert {(r["known_brand"], r["known_category"]) for r in out.collect()} == {("Nova", "Sports")} and out.count() == 50
    empty = phrases.with_known(asked, items.where("false"))
    assert empty.where("known_brand is null and known_category is null").count() == 50


def test_query_fields_of_messy_outputs(spark):
    items = spark.createDataFrame([("Aster", "Electronics")], "brand string, category string")
    full = {
        "intent": "price_sensitive_search", "category": "Electronics", "brand": None,
        "constraints": {"price": "budget", "use_case": "gym"}, "rewritten_query": "budget electronics gym",
        "expanded_queries": ["budget electronics", "Budget Electronics", " "], "confidence": "0.8",
    }
    odd = {
        "intent": " None ", "category": ["Electronics"], "brand": 5, "constraints": {"price": "", "use_case": 0},
        "price_constraint": "premium", "use_case": {"a": 1}, "rewritten_query": " ", "expanded_queries": [None, 3, True], "confidence": True,
    }
    outputs = [
        json.dumps(full), f"Here:\n```json\n{json.dumps(full)}\n```", json.dumps(odd), "{broken", "[1]", "", None, "{}",
        '{"a": "}"} trailing', json.dumps({**full, "constraints": [1], "expanded_queries": None, "confidence": {}}),
    ]
    rows = [(f"q{i}", "Budget electronics for gym", o) for i, o in enumerate(outputs)]
    answered = spark.createDataFrame(rows, "query_id string, query_text string, output_text string")
    got = {r["query_id"]: r for r in q.read_query_understanding(answered, items).collect()}
    for name in ("q0", "q1"):
        r = got[name]
        assert (r.parsed_intent, r.parsed_category, r.parsed_brand) == ("price_sensitive_search", "Electronics", None)
        assert (r.parsed_price_constraint, r.parsed_use_case, r.confidence) == ("budget", "gym", 0.8)
        assert r.expanded_queries == ["budget electronics for gym", "budget electronics"] and r.schema_valid
    r = got["q2"]
    assert (r.parsed_intent, r.parsed_category, r.parsed_brand) == (None, '["Electronics"]', "5")
    assert (r.parsed_price_constraint, r.parsed_use_case, r.confidence) == ("premium", '{"a":1}', 1.0)
    assert r.expanded_queries == ["budget electronics for gym", "none", "3"]
    assert r.rewritten_query == 'premium 5 ["electronics"] {"a":1}'
    for name in ("q3", "q4", "q5", "q6"):
        r = got[name]
        assert not r.schema_valid and r.confidence == 0.0 and r.parse_error
        assert (r.parsed_intent, r.parsed_category, r.parsed_price_constraint, r.parsed_use_case) == (
            "price_sensitive_search", "Electronics", "budget", "gym")
        assert r.rewritten_query == "budget electronics gym"
        assert r.expanded_queries == ["budget electronics for gym", "budget electronics gym", "electronics gym"]
    assert got["q4"].parse_error == "output is not a JSON object"
    r = got["q7"]
    assert r.schema_valid and r.confidence is None and r.rewritten_query == "budget electronics for gym"
    assert got["q8"].schema_valid
    r = got["q9"]
    assert (r.parsed_price_constraint, r.confidence, r.expanded_queries) == (None, None, ["budget electronics for gym"])


def test_profiles_of_messy_outputs(spark):
    schema = "user_id string, top_categories array<string>, top_brands array<string>, price_preference string, behavior_signals array<string>, recent_interests array<string>"
    summary = spark.createDataFrame([(f"u{i}", ["Sports"], ["Nova"], "budget", ["view"], ["shoe"]) for i in range(5)], schema)
    outputs = [
        ("u0", json.dumps({"summary": " likes running ", "top_brands": ["A", None, " ", 4], "top_categories": "Toys", "confidence": 0.4})),
        ("u1", '```\n{"profile_text": "", "behavior_signals": [], "confidence": "x"}\n```'),
        ("u2", "no json"), ("u3", None),
    ]
    answered = spark.createDataFrame(outputs, "user_id string, output_text string").withColumn("provider", F.lit("own"))
    got = {r["user_id"]: r for r in profiles.read_profiles(summary, answered).collect()}
    text = "Interests: Sports. Brands: Nova. Price preference: budget."
    sentence = "Profile based only on observed synthetic product interactions."
    r = got["u0"]
    assert (r.summary, r.top_brands, r.top_categories, r.confidence) == ("likes running", ["A", "None", "4"], ["Sports"], 0.4)
    assert r.profile_text == text and r.schema_valid and r.provider == "own"
    r = got["u1"]
    assert (r.summary, r.profile_text, r.behavior_signals, r.confidence, r.schema_valid) == (sentence, text, [], 0.0, True)
    for name in ("u2", "u3", "u4"):
        r = got[name]
        assert (r.summary, r.top_brands, r.confidence, r.schema_valid) == (sentence, ["Nova"], 0.0, False)
        assert r.parse_error == "output is not JSON"


def test_long_text_is_cut_in_one_pass(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(17_000)), lambda i: F.lpad(i.cast("string"), 6, "w"))
    text = spark.range(1).select(F.concat_ws(" ", words).alias("t")).cache()
    assert text.select(F.length("t")).first()[0] == 118_999
    begun = time.monotonic()
    cuts = text.select(phrases._substrings(F.col("t"), 6).alias("c"))
    assert cuts.select(F.size("c"), F.col("c")[118_993]).first() == (118_994, "w17000"[-6:])
    assert time.monotonic() - begun < 20
    short = spark.createDataFrame([("abcdef g",), ("abcde",), ("\U0001f600bcdef",)], "t string")
    got = [r.c for r in short.select(phrases._substrings(F.col("t"), 6).alias("c")).collect()]
    assert got[0] == ["abcdef", "bcdef ", "cdef g"] and got[1] == [] and "\U0001f600bcdef" in got[2]
