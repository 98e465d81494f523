"""Dropping edges: inconsistent alternatives, and everything but the optimum."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.operators import dp, leafsets
from cladeloom.operators.levels import reachable
from cladeloom.runtime import cut
from cladeloom.schema import HistoryDag

ARC = ["dag_id", "parent_id", "clade_index", "child_id"]


def _start(dag: HistoryDag) -> DataFrame:
    ua = dag.nodes.where(F.col("kind") == "ua").select("dag_id", "node_id")
    return ua


def keep_reachable(dag: HistoryDag, edges: DataFrame, start: DataFrame | None = None) -> HistoryDag:
    """The sub-DAG reachable from the pseudo-roots along ``edges``."""
    seen = reachable(edges, _start(dag) if start is None else start)
    parents = seen.withColumnRenamed("node_id", "parent_id")
    return HistoryDag(
        dag.nodes.join(seen, ["dag_id", "node_id"], "left_semi"),
        edges.join(parents, ["dag_id", "parent_id"], "left_semi"),
        dag.refs,
    )


def clade_coverage(arrived: DataFrame, clades: DataFrame, keys: list[str]) -> DataFrame:
    """Per edge of a contested clade: its leaf count and the clade's.

    ``arrived`` and ``clades`` are bitmaps of leaves: (edge, chunk, bits) and
    (clade, chunk, bits) rows.  A clade's leaves are those of all its
    alternatives, so one that has as many has them all.  ``complete`` says
    whether any alternative covers the whole clade.
    """
    by = [*keys, "parent_id", "clade_index"]
    one = arrived.groupBy(*by, "child_id", "chunk").agg(F.bit_or("bits").alias("bits"))
    leaves = F.sum(F.bit_count("bits")).cast("bigint")
    per_edge = one.groupBy(*by, "child_id").agg(leaves.alias("leaves"))
    per_clade = clades.groupBy(*by).agg(leaves.alias("clade_leaves"))
    best = per_edge.groupBy(*by).agg(
        F.max("leaves").alias("most"), F.count(F.lit(1)).alias("alternatives")
    )
    return (
        per_edge.join(best.join(per_clade, by), by)
        .where(F.col("alternatives") > 1)
        .withColumn("complete", F.col("most") == F.col("clade_leaves"))
        .withColumn("short", F.col("leaves") < F.col("clade_leaves"))
    )


def trim_inconsistent(dag: HistoryDag) -> tuple[HistoryDag, DataFrame]:
    """Drop alternatives that miss leaves of their clade while a complete one stays.

    Runs to a fixpoint; every round but the last removes edges.  Also returns (dag_id, edges_removed, unresolvable).
    """
    removed, columns = None, dag.edges.columns
    levels = leafsets.levels_with_bits(dag)
    while True:
        res = leafsets.leaf_bits(levels)
        cover = cut(clade_coverage(res.edges, res.clades, ["dag_id"]), "coverage")
        # A clade in which nothing is complete is counted once per round it is seen in.
        stuck = cover.where(~F.col("complete")).groupBy("dag_id").agg(
            F.count_distinct("parent_id", "clade_index").alias("unresolvable")
        )
        bad = cover.where(F.col("complete") & F.col("short")).select(*ARC)
        one = bad.groupBy("dag_id").agg(F.count(F.lit(1)).alias("edges_removed")).join(
            stuck, "dag_id", "full_outer"
        ).na.fill(0)
        removed = one if removed is None else removed.unionByName(one)
        if bad.isEmpty():
            break
        # Every clade keeps an alternative, so ranks stay an order of the nodes and leaves keep their bits.
        kept = keep_reachable(dag, cut(levels.ranked.join(bad, ARC, "left_anti"), "trim"))
        levels = replace(levels, ranked=cut(kept.edges, "ranked", ("child_rank",)))
        dag = HistoryDag(cut(kept.nodes, "trim-nodes"), levels.ranked.select(*columns), dag.refs)
    report = removed.groupBy("dag_id").agg(
        F.sum("edges_removed").alias("edges_removed"), F.sum("unresolvable").alias("unresolvable")
    )
    return dag, report


def trim_to_best(dag: HistoryDag, result: dp.Below) -> HistoryDag:
    """All optimal trees: best edges reachable from the pseudo-root, nodes shared."""
    best = result.best_edges().select(*ARC).distinct()
    return keep_reachable(dag, cut(dag.edges.join(best, ARC, "left_semi"), "best"))


def subtree(dag: HistoryDag, roots: DataFrame) -> HistoryDag:
    """The part of each DAG below the given (dag_id, node_id)."""
    return keep_reachable(dag, dag.edges, roots)
