"""Genomes of inner nodes from edge mutations, and leaf names from genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.functions.bases import apply_mutations, genome_string
from cladeloom.runtime import cut, materialise
from cladeloom.schema import GENOME, HistoryDag


def recompute_genomes(dag: HistoryDag) -> HistoryDag:
    """Node genomes from the root down, each along its first parent edge."""
    first = cut(
        dag.edges.groupBy("dag_id", "child_id").agg(
            F.min_by(F.struct("parent_id", "mutations"), "edge_id").alias("e")
        ).select("dag_id", "child_id", "e.parent_id", "e.mutations").join(
            dag.refs.select("dag_id", "reference_seq"), "dag_id"
        ),
        "first",
    )
    front = dag.roots().select("dag_id", "node_id", F.array().cast(GENOME).alias("cg"))
    seen = front = cut(front, "genomes")
    while True:
        below = front.withColumnsRenamed({"node_id": "parent_id", "cg": "parent_cg"})
        front = cut(
            first.join(below, ["dag_id", "parent_id"]).select(
                "dag_id", F.col("child_id").alias("node_id"),
                apply_mutations("parent_cg", "mutations", "reference_seq").alias("cg"),
            ),
            "genomes",
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    nodes = dag.nodes.drop("cg").join(seen, ["dag_id", "node_id"], "left").withColumn(
        "cg", F.coalesce("cg", F.array().cast(GENOME))
    )
    return materialise(dag.with_nodes(nodes.select(*dag.nodes.columns)), "genomes")


def name_leaves(dag: HistoryDag, coerce: bool = False) -> HistoryDag:
    """Leaf ids from genome text.

    Default: only blank ids are filled, equal genomes told apart by ``#N``.
    ``coerce`` renames every leaf to its genome text, so equal genomes share a name.
    """
    text = genome_string("cg")
    blank = (F.col("kind") == "leaf") & (F.coalesce("sample_id", F.lit("")) == "")
    if coerce:
        named = dag.nodes.withColumn("sample_id", F.when(F.col("kind") == "leaf", text).otherwise(F.col("sample_id")))
        return dag.with_nodes(named)
    todo = dag.nodes.where(blank).withColumn("text", text)
    # Numbers run per (DAG, slice of ids, genome); slices keep a popular genome off one task.
    slice_ = F.pmod(F.xxhash64("node_id"), F.lit(256))
    counts = todo.groupBy("dag_id", "text", slice_.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("dag_id", "text").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("dag_id", "text", "slice").orderBy("node_id")
    numbered = todo.withColumn("slice", slice_).withColumn("at", F.row_number().over(within) - 1).join(
        starts, ["dag_id", "text", "slice"]
    )
    number = F.col("start") + F.col("at")
    fresh = numbered.select(
        "dag_id", "node_id",
        F.when(number == 0, F.col("text")).otherwise(F.concat("text", F.lit("#"), number.cast("string"))).alias("fresh"),
    )
    nodes = dag.nodes.join(fresh, ["dag_id", "node_id"], "left").withColumn(
        "sample_id", F.coalesce("fresh", "sample_id")
    ).select(*dag.nodes.columns)
    return dag.with_nodes(nodes)
