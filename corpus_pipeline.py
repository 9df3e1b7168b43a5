"""The corpus pipeline: stages that each apply one operator to all documents that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.llm import block_names, mixing, pieces, shingle_join, toxic_spans
from aisle.llm.common import materialise
from aisle.llm.queries import table, tokenizer_file


#: Near duplicates share this percentage of their sets of so many words in a row.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxic_spans.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return block_names.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return shingle_join.one_per_group(docs, ngram=NEAR_WORDS, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are thinned or repeated to their target weights."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, variant, ids, n_tokens, ids_crc32`` of what is left."""
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.encode_documents(docs, model, keep=("lang", "source")).drop("text_sha256")


#: Each function takes the session, the documents that its predecessor kept and the folder of tables.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: A trained scorer, a keyed hash and a tokenizer take part, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
