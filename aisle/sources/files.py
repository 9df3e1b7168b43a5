"""Parquet and CSV sources and sinks, optional inputs, saved indexes and result tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from aisle.operators.clean import ensure_columns
from aisle.operators.retrieval import TermIndex


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet at ``path``; a missing path fails when the plan is built."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """Parquet at ``path`` or an empty frame of the same schema."""
    if path:
        try:
            return ensure_columns(spark.read.parquet(path), schema)
        except AnalysisException as error:
            if not _missing(error):
                raise
    return spark.createDataFrame([], schema)


def sink_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def scan_results_csv(
    spark: SparkSession, path: str, schema: T.StructType, required: bool = True
) -> DataFrame:
    """Results CSV; an optional one may be absent, a required one may not be absent or empty."""
    try:
        found = spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as error:
        if required or not _missing(error):
            raise
        return spark.createDataFrame([], schema)
    if required and not found.take(1):
        raise ValueError(f"required results are empty: {path}")
    return found


def scan_candidate_source(
    spark: SparkSession, augmented: str | None, base: str | None, source: str = "auto"
) -> DataFrame:
    """The augmented candidate table when there is one, else the base table."""
    options = []
    if source in ("auto", "multimodal") and augmented:
        options.append(augmented)
    if source in ("auto", "ranking") and base:
        options.append(base)
    for path in options:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if not _missing(error):
                raise
    raise FileNotFoundError(f"no candidate table for source {source}")


def upsert_results(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Rows of ``existing`` whose run key is not in ``new``, plus ``new``."""
    keyed = new.select(*keys).distinct()
    same = [existing[k].eqNullSafe(keyed[k]) for k in keys]
    kept = existing.join(keyed, same, "left_anti")
    merged = kept.unionByName(new, allowMissingColumns=True)
    return merged.orderBy(*(order or keys))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write to a fresh version folder, so the path being read is never overwritten."""
    path = f"{root}/version={version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def config_path(root: str, config: dict) -> str:
    """Folder named by the configuration, so a changed one never meets an old index."""
    text = json.dumps(config, sort_keys=True, default=str)
    return f"{root}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def save_index(index: TermIndex, root: str, config: dict, buckets: int = 64) -> str:
    """Write the tables of an index; postings are laid out by term for pruned reads."""
    path = config_path(root, {**config, "w": index.query_weighting, "n": index.normalize})
    placed = index.postings.repartitionByRange(buckets, "term", "item_id")
    placed.sortWithinPartitions("term", "item_id").write.mode("overwrite").parquet(
        f"{path}/postings"
    )
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.item_ids.write.mode("overwrite").parquet(f"{path}/items")
    meta = [(index.query_weighting, index.normalize)]
    spark = index.postings.sparkSession
    spark.createDataFrame(meta, "query_weighting string, normalize boolean").write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")
    return path


def load_index(spark: SparkSession, path: str) -> TermIndex:
    meta = spark.read.parquet(f"{path}/meta").first()
    return TermIndex(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/items"),
        meta["query_weighting"],
        meta["normalize"],
    )


def rows_in(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_rows"))
