"""Retrieval methods by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from aisle.operators import hybrid, representation, retrieval, vector_index

ENCODERS = ("text_only", "metadata_only", "text_metadata_fusion", "multimodal_fusion")


def encode_items(
    method: str,
    items: DataFrame,
    max_features: int = 5000,
    image_column: str = "image_embedding",
    **weights,
) -> tuple[retrieval.TermIndex | None, DataFrame]:
    """The text index and the fused vectors (item_id, feature, value) of the named encoder.

    ``weights`` go to ``fuse_vectors``. Items without an image, or a table without that column, get
    the blocks that they have.
    """
    if method not in ENCODERS:
        raise ValueError(f"unsupported encoder: {method}")
    text = None if method == "metadata_only" else representation.text_vectors(items, max_features)
    metadata = None if method == "text_only" else representation.metadata_vectors(items)
    image = None
    if method == "multimodal_fusion" and image_column in items.columns:
        image = representation.image_vectors(items, image_column)
    postings = None if text is None else text.postings
    return text, representation.fuse_vectors(postings, metadata, image, **weights)


def build_retriever(method: str, items: DataFrame, **settings) -> Callable[[DataFrame, int], DataFrame]:
    """A function (queries, k) -> ranked items for the named method.

    ``settings`` go to the index or search of the method, see ``aisle.operators.retrieval``.
    """
    if method == "bm25":
        index = retrieval.bm25_index(items, **settings)
        return lambda queries, k=50: retrieval.topk(index, queries, k)
    if method in ("dense", "tfidf", "faiss"):
        # term vectors are sparse, so their index finds the exact lists of an inner-product search
        index = retrieval.tfidf_index(items, **settings)
        return lambda queries, k=50: retrieval.topk(index, queries, k)
    if method == "hybrid":
        bm25 = retrieval.bm25_index(items, **settings.pop("bm25", {}))
        tfidf = retrieval.tfidf_index(items, **settings.pop("tfidf", {}))
        index = hybrid.fused_index(bm25, tfidf)
        return lambda queries, k=50: hybrid.hybrid_topk(index, queries, k, **settings)
    if method == "overlap_rerank":
        index = retrieval.bm25_index(items, **settings.pop("bm25", {}))
        return lambda queries, k=50: retrieval.overlap_rerank(index, items, queries, k, **settings)
    if method == "vector":
        # queries carry a ``vec`` themselves
        index = vector_index.build_vector_index(items.select("item_id", "vec"), **settings)
        return lambda queries, k=50: vector_index.ann_topk(index, queries, k)
    if method in ENCODERS:
        text, fused = encode_items(method, items, **settings)
        if text is None:
            raise ValueError(f"{method} has no text that a query could meet")
        index = representation.fused_index(items, fused, text)
        return lambda queries, k=50: retrieval.topk(index, queries, k)
    raise ValueError(f"unsupported retrieval method: {method}")
