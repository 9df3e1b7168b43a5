"""Ranking methods by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from aisle.operators import ranking

FEATURE_METHODS = ("linear", "gbt", "lightgbm", "mlp")
TEXT_METHODS = ("cross_encoder", "pair_text")


class Ranker:
    """A fitted method: ``score`` adds ``model_score`` to candidates, ``save`` writes what was fitted."""

    def __init__(self, method: str, model: PipelineModel | None, score: Callable[[DataFrame], DataFrame]):
        self.method, self.model, self.score = method, model, score

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError(f"{self.method} fits nothing that could be saved")
        self.model.write().overwrite().save(path)


def _fitted(method: str, model: PipelineModel, items: DataFrame | None) -> Ranker:
    if method in TEXT_METHODS:
        return Ranker(method, model, lambda rows: ranking.score_pair_text(model, rows, items))
    return Ranker(method, model, lambda rows: ranking.score_candidates(model, rows))


def _check(method: str, items: DataFrame | None) -> None:
    if method not in (*FEATURE_METHODS, *TEXT_METHODS, "mixed"):
        raise ValueError(f"unsupported ranking method: {method}")
    if method in TEXT_METHODS and items is None:
        raise ValueError(f"{method} needs the items whose texts it reads")


def build_ranker(
    method: str, candidates: DataFrame, items: DataFrame | None = None, **settings
) -> Ranker:
    """Fit the named method on the train split of ``candidates``; the mixed method only weighs columns."""
    _check(method, items)
    if method == "mixed":
        return Ranker(method, None, lambda rows: ranking.mixed_rank(rows, **settings))
    if method in TEXT_METHODS:
        return _fitted(method, ranking.pair_text_ranker(candidates, items, **settings), items)
    return _fitted(method, ranking.train_ranker(candidates, method, **settings), items)


def load_ranker(method: str, path: str, items: DataFrame | None = None) -> Ranker:
    _check(method, items)
    return _fitted(method, PipelineModel.load(path), items)
