"""Structural checks of a history DAG; an empty report means a valid one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.operators import leafsets
from cladeloom.operators.levels import reachable
from cladeloom.operators.trim import clade_coverage
from cladeloom.schema import HistoryDag


def _row(df: DataFrame, check: int, node: Column, detail: str) -> DataFrame:
    return df.select(
        "dag_id", F.lit(check).alias("check"), node.cast("string").alias("node_id"),
        F.lit(detail).alias("detail"),
    )


def edge_checks(dag: HistoryDag) -> DataFrame:
    """Checks 1-4, 6 and 7: those that need no traversal."""
    nodes, edges = dag.nodes, dag.edges
    uas = nodes.where(F.col("kind") == "ua")
    count = dag.refs.select("dag_id").join(uas, "dag_id", "left").groupBy("dag_id").agg(
        F.count("node_id").alias("n")
    )
    out = [_row(count.where(F.col("n") != 1), 1, F.lit(None), "root is not the pseudo-root")]
    # Nodes and both ends of all edges meet in one aggregate; an end without an id is no node's.
    marks = ["known", "ua", "leaf", "children", "parents"]

    def marked(df, end, **mark):
        one = lambda m: mark[m].cast("int") if m in mark else F.lit(0)
        return df.select("dag_id", F.col(end).alias("node_id"), *[one(m).alias(m) for m in marks])

    yes, kind = F.lit(1), F.coalesce("kind", F.lit(""))
    rows = [
        marked(nodes, "node_id", known=yes, ua=kind == "ua", leaf=kind == "leaf"),
        marked(edges, "child_id", children=yes), marked(edges, "parent_id", parents=yes),
    ]
    met = reduce(DataFrame.unionByName, rows).groupBy("dag_id", "node_id").agg(*[F.sum(m).alias(m) for m in marks])
    named = F.col("dag_id").isNotNull() & F.col("node_id").isNotNull()
    lost = ~named | (F.col("known") == 0)
    finding = lambda times, check, detail: F.struct(times.cast("int").alias("times"), F.lit(check).alias("check"), F.lit(detail).alias("detail"))
    none = F.lit(0)
    found = met.select("dag_id", "node_id", F.inline(F.array(
        finding(F.when(named & (F.col("ua") > 0), F.col("children")).otherwise(none), 2, "root has a parent"),
        finding(F.when(lost, F.col("children")).otherwise(none), 3, "edge to a missing node"),
        finding(F.when(lost, F.col("parents")).otherwise(none), 3, "edge from a missing node"),
        finding(F.when(named & (F.col("parents") > 0), F.col("leaf")).otherwise(none), 4, "leaf has children"),
    ))).where("times > 0")
    out.append(found.select(
        "dag_id", "check", F.col("node_id").cast("string").alias("node_id"), "detail", F.explode(F.sequence(F.lit(1), "times"))
    ).drop("col"))
    spread = edges.groupBy("dag_id", "parent_id", "child_id").agg(
        F.min("clade_index").alias("lo"), F.max("clade_index").alias("hi")
    )
    out.append(_row(spread.where("lo <> hi"), 6, F.col("child_id"), "child in more than one clade"))
    gaps = (
        edges.groupBy("dag_id", "parent_id", "clade_index").count()
        .groupBy("dag_id", "parent_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("clade_index").alias("lo"), F.max("clade_index").alias("hi"))
    )
    out.append(_row(gaps.where("lo <> 0 or hi + 1 <> n"), 7, F.col("parent_id"), "clade indices are not contiguous"))
    return reduce(DataFrame.unionByName, out)


def validate(dag: HistoryDag) -> DataFrame:
    """(dag_id, check, node_id, detail) for every violated invariant."""
    starts = dag.nodes.where(F.col("kind") == "ua").select("dag_id", "node_id")
    seen = reachable(dag.edges, starts)
    lost = dag.nodes.join(seen, ["dag_id", "node_id"], "left_anti")
    report = edge_checks(dag).unionByName(
        _row(lost, 5, F.col("node_id"), "not reachable from the root")
    )
    sets = leafsets.leaf_bits(leafsets.levels_with_bits(dag))
    cover = clade_coverage(sets.edges, sets.clades, ["dag_id"])
    uneven = cover.where("short").select("dag_id", "parent_id").distinct()
    return report.unionByName(
        _row(uneven, 8, F.col("parent_id"), "alternatives of a clade have different leaf sets")
    )
