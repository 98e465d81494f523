"""All registered queries."""

from cladeloom.plans import dag_queries, dp_queries, interval_queries, merge_queries, move_queries, sequence_queries  # noqa: F401
from cladeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
