"""Personal data by gradient boosting over candidate spans, DataFrame functions and Spark ML only.

Generators with high recall propose overlapping candidates: everything around an at sign (also a
spelled one) and every run of digits and separators. Inside each run the exact patterns of a kind
name the base spans. Boosted trees learn from a bounded sample per kind, with features of format and
context that do not repeat the patterns' checks. A candidate is labelled whatever its surface: it is
private if it is a base span, has the digits or the address of one elsewhere, or passes its kind's
check in normal form next to a word of its kind; it is not if it fails that check. Others have no
label and count in no precision. Per kind the lowest threshold that keeps the precision on all
held-out labels is taken, and candidates above it that overlap no base span are added.

Positions come from cutting the text at the matches of a pattern: gaps and matches add up.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.common import by_size, materialise

#: Kinds in the order that breaks ties, and their exact patterns. Possessive repeats
#: and the look-behinds start and end where the plain patterns do, in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: runs that no base span of their kinds leaves.
ROUND_AT = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9._%+@-]*"
SPELLED_AT = (
    r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++"
)
DIGITS = r"(?:\((?=[0-9]))?[0-9+][0-9 ().+-]*[0-9]"
#: Separate numbers inside a run of digits, as further, overlapping candidates.
NUMBERS = r"\(?[0-9]++(?:[ .()-]{1,2}[0-9]++)*+"

#: Words before a candidate that tell its kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|write|contact|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|paid)\b",
    "phone": r"(?i)\b(?:phone|call|tel|telephone|fax|mobile|cell|dial|ring|text)\b",
}
BEFORE_CHARS = 24

#: Rows that the trees learn from, of each kind and label.
SAMPLE_ROWS = 5_000
TREES = 12
DEPTH = 3
PRECISION = 0.98
LEAST_SCORE = 0.5
#: Steps of the scores among which the thresholds are looked for.
LEVELS = 1000
SEED = 7


def _cut(text: Column, pattern: str) -> Column:
    """The gap before each match and the match, in order; the rest of the text comes with null."""
    before = lambda x: F.substring(x, -BEFORE_CHARS, BEFORE_CHARS)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), before(x).alias("b")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(
        gaps, found, lambda gap, match: F.struct(gap["n"].alias("gap"), match.alias("match"), gap["b"].alias("before"))
    )


def _one(match: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("gap"), match.alias("match"), F.lit("").alias("before")))


def _where(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast("array<struct<gap:int,match:string,before:string>>"))


def _placed(rows: DataFrame, keys: list[str], origin: Column) -> DataFrame:
    """Adds ``start`` and ``end`` from gaps and matches in the order of ``at``."""
    earlier = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum(F.col("gap") + F.length("match")).over(earlier)
    return rows.withColumn("end", (origin + through).cast("long")).withColumn(
        "start", (F.col("end") - F.length("match")).cast("long")
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = lambda i: F.substring(F.reverse(digits), i, 1).try_cast("int")
    twice = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    total = F.aggregate(
        places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(value(i))
    )
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match of a kind's pattern passes its check."""
    digits = _digits(match)
    n = F.length(digits)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)))
        .otherwise(n.between(9, 15))
    )


def _runs(docs: DataFrame) -> DataFrame:
    """One row per candidate run with its ``start``, and one bare row per document."""
    text = F.col("text")
    groups = {
        "doc": _one(F.lit("")),
        "at": _where(text.contains("@"), _cut(text, ROUND_AT)),
        "spelled": _where(text.rlike(r"[\[(]at[\])]"), _cut(text, SPELLED_AT)),
        "digits": _where(text.rlike("[0-9]"), _cut(text, DIGITS)),
    }
    runs = F.array(*[F.struct(F.lit(k).alias("run"), g.alias("found")) for k, g in groups.items()])
    each = docs.select("row", "doc_id", F.explode(runs).alias("g"))
    each = each.select("row", "doc_id", "g.run", F.posexplode("g.found").alias("at", "f"))
    each = each.where("f.match is not null").select("row", "doc_id", "run", "at", "f.gap", "f.match", "f.before")
    # later windows and groups keep to the row, so the rows move once
    return _placed(each.repartition("row"), ["row", "run"], F.lit(0)).drop("gap", "at")


def candidates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end, match, base`` of base spans and further candidates.

    Each document has one more row of kind null. ``docs`` has ``row, doc_id, text``.
    """
    runs = _runs(docs).withColumnRenamed("start", "origin").drop("end")
    run, body = F.col("run"), F.col("match")
    enough = (run == "digits") & (F.length(_digits(body)) >= 4)
    tries = [(F.lit(None).cast("string"), True, _where(run == "doc", _one(body)))]
    for kind in KINDS:
        where = (run == "at") if kind == "email" else enough
        tries.append((F.lit(kind), True, _where(where, _cut(body, BASE[kind]))))
    tries.append((F.lit("email"), False, _where(run.isin("at", "spelled"), _one(body))))
    for kind in ("ip", "card", "phone"):
        tries.append((F.lit(kind), False, _where(enough, _cut(body, NUMBERS))))
    all_tries = F.array(
        *[F.struct(k.alias("kind"), F.lit(e).alias("exact"), f.alias("found")) for k, e, f in tries]
    )
    each = runs.select("row", "doc_id", "run", "origin", "before", F.explode(all_tries).alias("t"))
    each = each.select(
        "row", "doc_id", "run", "origin", "before", "t.kind", "t.exact", F.posexplode("t.found").alias("at", "f")
    )
    # what stands before a run also stands before what is inside of it
    each = each.where("f.match is not null").select(
        "row", "doc_id", "run", "origin", "before", "kind", "exact", "at", "f.gap", "f.match"
    )
    placed = _placed(each, ["row", "run", "origin", "kind", "exact"], F.col("origin"))
    kept = F.col("kind").isNull() | ~F.col("exact") | _valid(F.col("kind"), F.col("match"))
    return placed.where(kept).select(
        "row", "doc_id", "kind", "start", "end", "match", F.col("exact").alias("base"), "run", "before"
    )


def _address(match: Column) -> Column:
    """An address with its at sign and dots spelled as signs."""
    signs = F.regexp_replace(F.lower(match), r" ?[\[(]at[\])] ?", "@")
    return F.btrim(F.regexp_replace(signs, r" ?(?:[\[(]dot[\])]|\.) ?", "."), F.lit("."))


def _normal(kind: Column, match: Column) -> Column:
    """What equal data share in whatever form: the address, the digits, of a phone its last ten."""
    digits = _digits(match)
    return (
        F.when(kind == "email", _address(match))
        .when(kind == "ip", F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", ""))
        .when(kind == "phone", F.substring(digits, -10, 10))
        .otherwise(digits)
    )


def _passes(kind: Column, match: Column) -> Column:
    """Whether a candidate passes its kind's check in normal form."""
    digits = _digits(match)
    n = F.length(digits)
    grouped = match.rlike(r"[0-9][ .()-]+[0-9]")
    national = digits.rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & grouped
    abroad = digits.rlike(r"^00[1-9]") & n.between(11, 17) & grouped
    mail = r"^[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}$"
    return (
        F.when(kind == "email", _address(match).rlike(mail))
        .when(kind == "phone", national | abroad)
        .otherwise(_valid(kind, match))
    )


#: Format and context of a candidate; none repeats the check digit, the plus sign or the byte range.
FEATURES = {
    "kind": "array_position(array('email', 'ip', 'card', 'phone'), kind)",
    "length": "least(length(match), 60)",
    "digits": "least(length(regexp_replace(match, '[^0-9]+', '')), 40)",
    "letters": "least(length(regexp_replace(match, '[^A-Za-z]+', '')), 60)",
    "dots": "least(length(regexp_replace(match, '[^.]+', '')), 10)",
    "spaces": "least(length(regexp_replace(match, '[^ ]+', '')), 10)",
    "hyphens": "least(length(regexp_replace(match, '[^-]+', '')), 10)",
    "brackets": "least(length(regexp_replace(match, '[^()]+', '')), 6)",
    "groups": "least(size(split(match, '[^0-9A-Za-z]+')), 20)",
    "first": "least(length(regexp_extract(match, '^[^0-9]*([0-9]*)', 1)), 20)",
    "last": "least(length(regexp_extract(match, '([0-9A-Za-z]*)$', 1)), 20)",
    "leading": "try_cast(regexp_extract(match, '([0-9])', 1) as int)",
    "big_groups": "size(filter(split(match, '[^0-9]+'), g -> length(g) > 3))",
    "at": "cast(match like '%@%' or run = 'spelled' as int)",
    "domain": "cast(match rlike '[A-Za-z0-9-]+[.][A-Za-z]{2,}$' as int)",
    "siblings": "least(siblings, 10)",
}


def overlaps(found: DataFrame) -> DataFrame:
    """Adds ``siblings``, ``taken`` and ``_same``: overlap with a base span, or its kind and end.

    In the order of the base spans' starts and the others' ends, the largest end of the base spans so
    far tells whether one of them reaches into a candidate. The rows of a text move once.
    """
    base = F.col("base")
    # base spans are not counted, as they would give the label away
    siblings = F.count(F.when(~base, 1)).over(Window.partitionBy("row", "run"))
    at = F.when(base, F.col("start")).otherwise(F.col("end") - 1)
    earlier = Window.partitionBy("row").orderBy(at, base.desc()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(base, F.col("end"))).over(earlier)
    start = F.max(F.when(base, F.col("start"))).over(Window.partitionBy("row", "kind", "end"))
    return found.repartition("row").withColumns(
        {
            "siblings": siblings,
            "taken": F.coalesce(reach > F.col("start"), F.lit(False)),
            "_same": F.coalesce(start >= F.col("start") - 1, F.lit(False)),
        }
    )


def featured(found: DataFrame) -> DataFrame:
    """Candidates that are not base spans, with features, the label and overlap with base spans."""
    rows = overlaps(found.where("kind is not null")).where("not base")
    passes = _passes(F.col("kind"), F.col("match"))
    context = F.lit(False)
    for kind, words in CONTEXT.items():
        context = context | ((F.col("kind") == kind) & F.col("before").rlike(words))
    rows = rows.withColumns({"_passes": passes, "_context": context})
    key = F.xxhash64("kind", _normal(F.col("kind"), F.col("match")))
    known = found.where("kind is not null and base").select(key.alias("_key")).distinct()
    known = by_size(materialise(known, "known").withColumn("_known", F.lit(True)))
    rows = rows.withColumn("_key", key).join(known, "_key", "left")
    spelled = (F.col("kind") == "email") & (F.col("run") == "spelled")
    sure = F.col("_same") | (F.col("_passes") & (F.coalesce("_known", F.lit(False)) | F.col("_context") | spelled))
    label = F.when(sure, 1.0).when(~F.col("_passes"), 0.0)
    rows = rows.withColumn("label", label).drop("_key", "_known", "_same", "_passes", "_context")
    return rows.withColumns({f"f_{name}": F.coalesce(F.expr(sql).cast("double"), F.lit(-1.0)) for name, sql in FEATURES.items()})


def _boosted(rows: DataFrame, trees: int, depth: int, sample: int, precision: float) -> DataFrame:
    """The candidates that the calibrated model adds: ``row, doc_id, kind, start, end``."""
    empty = rows.where("false").select("row", "doc_id", "kind", "start", "end")
    order = F.xxhash64(F.lit(SEED), "match", "kind", "doc_id", "start")
    known = rows.where("label is not null").withColumn("_fold", F.pmod(order, F.lit(4)))
    # each kind and label has about as many rows in the sample, at most all it has
    sizes = known.where("_fold <> 0").groupBy("kind", "label").count().collect()
    if len({r.label for r in sizes}) < 2:
        return empty
    share = F.lit(0)
    for r in sizes:
        share = F.when((F.col("kind") == r.kind) & (F.col("label") == r.label), int(1e6 * min(1, sample / r["count"]))).otherwise(share)
    picked = F.pmod(F.xxhash64(F.lit(SEED + 1), "match", "kind", "doc_id", "start"), F.lit(1_000_000)) < share
    train = materialise(known.where("_fold <> 0").where(picked), "sample")
    if train.select("label").distinct().count() < 2:
        return empty
    names = [f"f_{n}" for n in FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED, labelCol="label").fit(vectors.transform(train))
    score = lambda df: model.transform(vectors.transform(df)).withColumn("score", vector_to_array("probability")[1])
    # per kind the lowest score above which all held-out labels keep the precision
    above = Window.partitionBy("kind").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = (
        score(known.where("_fold = 0"))
        .groupBy("kind", F.floor(F.col("score") * LEVELS).alias("level"))
        .agg(F.sum("label").alias("hits"), F.count("*").alias("all"))
        .withColumns({"hits": F.sum("hits").over(above), "all": F.sum("all").over(above)})
        .where(F.col("hits") >= precision * F.col("all"))
        .groupBy("kind")
        .agg(F.greatest(F.min("level") / LEVELS, F.lit(LEAST_SCORE)).alias("bar"))
    )
    # at most one row per kind; what fails its kind's check is not added
    addable = rows.where("not taken").where("label is null or label > 0")
    chosen = score(addable).join(F.broadcast(levels), "kind").where("score >= bar")
    best = Window.partitionBy("row", "start", "end").orderBy(F.col("score").desc(), "kind")
    return chosen.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("row", "doc_id", "kind", "start", "end")


def private_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    precision: float = PRECISION,
) -> DataFrame:
    """``row, doc_id, kind, start, end, base``: all spans, and one row of kind null per document.

    Null texts count as empty; null ids and repeated rows keep rows of their own. Without base spans
    to learn from nothing is added. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = materialise(candidates(rows), "candidates")
    rows = materialise(featured(found), "features")
    added = _boosted(rows, trees, depth, sample, precision)
    base = found.where("kind is null or base").select("row", "doc_id", "kind", "start", "end")
    return base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))


def private_digest(spans: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans as text."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", place.alias("place"), "end", "kind", "base")
    listed = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"),
    )
    write = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return listed.select("doc_id", *counts, F.sha2(write(base), 256).alias("base_sha256"), write(F.col("all")).alias("spans"))


def redacted(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """``row, doc_id, text`` with each span replaced by its kind; ``docs`` has ``row`` and the text.

    Of overlapping spans the first one is replaced.
    """
    place = F.array_sort(F.collect_list(F.struct("start", "end", "kind")))
    listed = spans.where("kind is not null").groupBy("row").agg(place.alias("_spans"))
    done = F.aggregate(
        F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))),
    )
    return docs.join(listed, "row", "left").withColumn(text, done).drop("_spans")
