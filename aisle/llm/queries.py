"""The registered queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.llm import (
    block_names,
    hilbert,
    mixing,
    pieces,
    private_data,
    quality,
    shingle_join,
    token_files,
    toxic_spans,
    wrappers,
)
from aisle.session import deliver_package, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    deliver_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "llm-tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_token_files(docs, path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.token_summary(spark, path)


@query(
    "op2_block_names",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
)
def op2_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    holds = []
    for rule in quality.RULES:
        fails = []
        if rule.most is not None:
            fails.append(f"{rule.top} > {rule.bottom} * {rule.most}::DOUBLE")
        if rule.least is not None:
            fails.append(f"{rule.top} < {rule.bottom} * {rule.least}::DOUBLE")
        holds.append(f"NOT (({' OR '.join(fails)}) AND n_words >= {rule.from_words})")
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH body AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_replace(l, '{space}', '', 'g') <> '') AS ls
  FROM body),
windows AS (
  SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM split)),
repeats AS (
  SELECT r, i + k AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows), range(5) AS f(k)
  WHERE c > 1),
covered AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM repeats GROUP BY r),
counts AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda w: NOT regexp_matches(w, '\\p{{L}}'))) AS n_bare_words,
    len(list_filter(regexp_split_to_array(lower(regexp_replace(t, '[[:punct:]]', '', 'g')), '{space}'),
      lambda w: w IN ({stops}))) AS n_stop_words
  FROM split LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(holds)} AS kept
FROM judged
"""


@query("op5_quality", _quality_sql())
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op6_hilbert")
def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


@query("op7_pieces")
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


_SHINGLES = r"""
WITH RECURSIVE body AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 3], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM body WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query("op10_shingle_join", _SHINGLES)
def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxic_spans")
def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxic_spans.score_documents(docs, labels).drop("spans")


@query("op9_wrappers")
def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@query("op8_private_data")
def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_digest(private_data.private_spans(table(spark, sf_dir, "documents")))


from aisle.llm import audit_queries  # noqa: E402, F401  registers operators 11 to 13
