"""Phylogenetic history DAGs as Spark DataFrames."""

from cladeloom.schema import HistoryDag

__all__ = ["HistoryDag"]
