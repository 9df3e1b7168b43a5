"""Item vectors from text, metadata and images, their fusion, and cold-start slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.operators.quantiles import exact_quantile
from aisle.operators.retrieval import TermIndex, encode_queries, tfidf_index
from aisle.operators.vectors import l2_normalize

CATEGORICAL = ("category", "brand")
NUMERIC = ("price", "avg_rating", "rating_count")
LOG_NUMERIC = ("rating_count",)


def text_vectors(items: DataFrame, max_features: int = 5000) -> TermIndex:
    """The TF-IDF index seen as sparse item vectors (item_id, term, weight)."""
    return tfidf_index(items, max_features)


def text_query_vectors(index: TermIndex, texts: DataFrame) -> DataFrame:
    return encode_queries(index, texts)


def metadata_vectors(
    items: DataFrame,
    fitted_on: DataFrame | None = None,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    log_numeric: Sequence[str] = LOG_NUMERIC,
    normalize: bool = True,
) -> DataFrame:
    """(item_id, feature, value): one-hot categories and z-scored numbers.

    A category value that ``fitted_on`` never had gives no entry, which reads as zero.
    """
    source = items if fitted_on is None else fitted_on

    def numbers(df: DataFrame) -> dict[str, Column]:
        out = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric}
        for n in log_numeric:
            value = F.greatest(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))
            out[f"log_{n}"] = F.log1p(value)
        return out

    values = numbers(items)
    if normalize:
        fitted = numbers(source)
        stats = source.agg(
            F.struct(
                *[F.avg(c).alias(f"m_{n}") for n, c in fitted.items()],
                *[F.stddev_samp(c).alias(f"s_{n}") for n, c in fitted.items()],
            ).alias("s")
        ).scalar()
        items = items.withColumn("_s", stats)

        def scaled(name: str, value: Column) -> Column:
            spread = F.col(f"_s.s_{name}")
            return (value - F.col(f"_s.m_{name}")) / F.when(spread > 0, spread).otherwise(1.0)

        values = {n: scaled(n, c) for n, c in values.items()}
    entries = [F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in values.items()]
    for field in categorical:
        feature = F.concat(F.lit(f"{field}="), F.col(field))
        entries.append(F.struct(feature.alias("feature"), F.lit(1.0).alias("value")))
    long = (
        items.withColumn("_e", F.explode(F.array(*entries)))
        .select("item_id", F.col("_e.feature").alias("feature"), F.col("_e.value").alias("value"))
        .where("feature is not null")
    )
    if fitted_on is None:
        return long
    known = metadata_features(source, categorical, numeric, log_numeric)
    return skew.join(long, known.select("feature"), "feature", "left_semi", row_id=["item_id"])


def metadata_features(
    items: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    log_numeric: Sequence[str] = LOG_NUMERIC,
) -> DataFrame:
    """(feature, place): category values in field order, each sorted, then the sorted numbers."""
    pairs = [
        F.struct(F.lit(i).alias("block"), F.concat(F.lit(f"{f}="), F.col(f)).alias("feature"))
        for i, f in enumerate(categorical)
    ]
    categories = items.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    last = len(categorical)
    names = [*numeric, *[f"log_{n}" for n in log_numeric]]
    numbers = items.sparkSession.createDataFrame([(last, n) for n in names], categories.schema)
    both = categories.where("feature is not null").unionByName(numbers)
    order = [F.col("block"), F.col("feature")]
    numbered = skew.row_number(both, [], order, "n", ["feature"])
    return numbered.select("feature", (F.col("n") - 1).alias("place"))


def image_vectors(items: DataFrame, column: str = "image_embedding", normalize: bool = True) -> DataFrame:
    """(item_id, vec) of items whose vector has the most common size (the smaller on a tie).

    Items without one, or with another size, have no row, which reads as a zero vector.
    """
    sized = items.where(F.size(column) > 0).withColumn("_d", F.size(column))
    counts = sized.groupBy("_d").count()
    dim = counts.agg(F.max_by("_d", F.struct("count", -F.col("_d")))).scalar()
    vector = l2_normalize(column) if normalize else F.transform(column, lambda x: x.cast("double"))
    return sized.where(F.col("_d") == dim).select("item_id", vector.alias("vec"))


def image_available_rate(items: DataFrame, column: str = "image_embedding") -> DataFrame:
    has = F.when(F.size(column) > 0, 1.0).otherwise(0.0)
    return items.agg(F.coalesce(F.avg(has), F.lit(0.0)).alias("image_available_rate"))


def hash_vectors(items: DataFrame, dim: int = 8) -> DataFrame:
    """(item_id, vec): the first bytes of the id's SHA-256 over 255, unit length."""
    digest = F.sha2(F.col("item_id").cast("string"), 256)
    parts = [
        F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255.0 for i in range(dim)
    ]
    return items.select("item_id", l2_normalize(F.array(*parts)).alias("vec"))


def fuse_vectors(
    text: DataFrame | None,
    metadata: DataFrame | None,
    image: DataFrame | None = None,
    text_weight: float = 0.75,
    metadata_weight: float = 0.25,
    image_weight: float = 0.0,
    normalize: bool = True,
) -> DataFrame:
    """(item_id, feature, value): weighted blocks under prefixed names, unit length per item."""
    blocks = []
    if text is not None:
        blocks.append(
            text.select("item_id", F.concat(F.lit("text:"), "term").alias("feature"),
                        (F.col("weight") * text_weight).alias("value"))
        )
    if metadata is not None:
        blocks.append(
            metadata.select("item_id", F.concat(F.lit("meta:"), "feature").alias("feature"),
                            (F.col("value") * metadata_weight).alias("value"))
        )
    if image is not None:
        long = image.select("item_id", F.posexplode("vec").alias("p", "value"))
        blocks.append(
            long.select("item_id", F.format_string("image:%05d", "p").alias("feature"),
                        (F.col("value") * image_weight).alias("value"))
        )
    fused = blocks[0]
    for block in blocks[1:]:
        fused = fused.unionByName(block)
    if normalize:
        per_item = Window.partitionBy("item_id")
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(per_item))
        fused = fused.withColumn(
            "value", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value"))
        )
    return fused


def fused_index(items: DataFrame, fused: DataFrame, text: TermIndex) -> TermIndex:
    """Search index over fused vectors.

    Queries carry text only, so only the text block of an item can meet them; its entries keep
    the scale the whole fused vector gave them.
    """
    postings = fused.where(F.col("feature").startswith("text:")).select(
        "item_id", F.expr("substr(feature, 6)").alias("term"), F.col("value").alias("weight")
    )
    return TermIndex(postings, text.terms, items.select("item_id"), "tfidf", True)


def item_embeddings(
    items: DataFrame, fused: DataFrame, method: str, has_image: Column | None = None
) -> DataFrame:
    """One dense array per item over the sorted feature names, with method flags.

    Feature names are bounded by the vocabulary limit and the metadata values.
    """
    names = fused.select("feature").distinct()
    places = skew.row_number(names, [], [F.col("feature")], "place", ["feature"])
    dim = names.agg(F.count("*")).scalar()
    placed = skew.join(fused, places, "feature", row_id=["item_id"])
    entries = placed.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("e")
    )
    dense = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("embedding_dim")),
        lambda i: F.coalesce(F.col("e")[i], F.lit(0.0)),
    )
    image = F.lit(False) if has_image is None else has_image
    return (
        items.select("item_id")
        .join(entries, "item_id", "left")
        .withColumn("embedding_dim", dim)
        .select(
            "item_id",
            dense.alias("embedding"),
            "embedding_dim",
            F.lit(method).alias("method"),
            F.lit(method != "metadata_only").alias("has_text_features"),
            F.lit(method != "text_only").alias("has_metadata_features"),
            image.alias("has_image_features"),
        )
    )


def interaction_counts(items: DataFrame, train: DataFrame) -> DataFrame:
    counts = train.groupBy("item_id").agg(F.count("*").alias("interaction_count"))
    return items.join(counts, "item_id", "left").withColumn(
        "interaction_count", F.coalesce("interaction_count", F.lit(0))
    )


def _low_count(counted: DataFrame, quantile: float) -> Column:
    """The quantile of the counts; some item always reaches it, as it is at least the minimum."""
    return exact_quantile(counted, "interaction_count", quantile, [], "q").scalar()


def cold_start_items(items: DataFrame, train: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Items whose train count is at most the (interpolated) quantile, zeros included."""
    counted = interaction_counts(items.select("item_id"), train)
    return counted.where(F.col("interaction_count") <= _low_count(counted, quantile))


long_tail_items = cold_start_items


def flag_cold_start(
    items: DataFrame, train: DataFrame, cold_quantile: float = 0.25, tail_quantile: float = 0.25
) -> DataFrame:
    counted = interaction_counts(items, train)
    count = F.col("interaction_count")
    return counted.withColumns(
        {
            "is_cold_start": count <= _low_count(counted, cold_quantile),
            "is_long_tail": count <= _low_count(counted, tail_quantile),
        }
    ).drop("interaction_count")
