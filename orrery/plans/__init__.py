"""The registered queries and the SQL that gives the same rows."""

from orrery.plans import collection_plans, graph_plans, kv_plans, stream_plans, vector_plans  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
