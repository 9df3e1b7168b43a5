"""Queries with their SQL counterparts, one module per area."""

from checks import base, data, evaluation, generation, plans, ranking, recommend, retrieval, vectors

QUERIES, ORACLES = base.QUERIES, base.oracles()
__all__ = ["QUERIES", "ORACLES", "data", "evaluation", "generation", "plans", "ranking", "recommend", "retrieval", "vectors"]
