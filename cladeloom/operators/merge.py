"""Content-addressed union of many DAGs.

Every node gets a label hashed from what it is: a leaf from its sample id, an
inner node from its genome and the leaf sets of its clades.  Equal labels are
one node, so merging is two keyed aggregates with no id remapping, and adding a
DAG later only adds rows to them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.bases import edge_mutations, genome_string
from cladeloom.functions.setkeys import key_text, singleton_key
from cladeloom.operators import leafsets
from cladeloom.operators.levels import EdgeLevels
from cladeloom.operators.trim import trim_inconsistent
from cladeloom.runtime import cut
from cladeloom.schema import GENOME, HistoryDag

UA_LABEL = "UA"


def node_labels(dag: HistoryDag, keys: leafsets.LeafKeys) -> DataFrame:
    """Nodes (pseudo-root left out) with ``key`` and content ``label``."""
    body = dag.nodes.where(F.col("kind") != "ua")
    leaves = body.where(F.col("kind") == "leaf").select(
        "*",
        singleton_key(F.col("sample_id")).alias("key"),
        F.md5(F.concat(F.lit("L|"), "sample_id")).alias("label"),
    )
    inner = (
        body.where(F.col("kind") == "inner")
        .join(keys.nodes.select("dag_id", "node_id", "key", "split"), ["dag_id", "node_id"])
        .withColumn(
            "label",
            F.md5(F.concat_ws("|", F.lit("I"), key_text(F.col("split")), genome_string("cg"))),
        )
        .drop("split")
    )
    return leaves.unionByName(inner)


@dataclass(frozen=True)
class Labelled:
    """Label-keyed rows of any number of DAGs, before deduplication.

    ``edges`` carries ``key``, the leaf set of the child, which names the clade
    of the parent the edge belongs to.
    """

    nodes: DataFrame
    edges: DataFrame
    root_edges: DataFrame
    refs: DataFrame


def label(dag: HistoryDag, keys: leafsets.LeafKeys, group: Column) -> Labelled:
    # Written by kind: parents are inner nodes, mostly few, and their files tell so.
    nodes = cut(node_labels(dag, keys), "labels", ("kind",))
    child = nodes.select("dag_id", F.col("node_id").alias("child_id"), F.col("label").alias("child"), "key")
    parent = nodes.where(F.col("kind") == "inner").select(
        "dag_id", F.col("node_id").alias("parent_id"), F.col("label").alias("parent")
    )
    uas = dag.nodes.where(F.col("kind") == "ua").select("dag_id", F.col("node_id").alias("parent_id"))
    edges = dag.edges.select("dag_id", "parent_id", "child_id", "clade_index", "edge_weight").join(
        child, ["dag_id", "child_id"]
    )
    pick = group.alias("g")
    return Labelled(
        nodes.select(pick, "dag_id", "label", "kind", "sample_id", "cg", "key"),
        edges.join(parent, ["dag_id", "parent_id"]).select(
            pick, "dag_id", "parent_id", "parent", "child", "key", "clade_index", "edge_weight"
        ),
        edges.join(uas, ["dag_id", "parent_id"]).select(pick, "child", "edge_weight"),
        dag.refs.select(pick, "dag_id", "reference_id", "reference_seq"),
    )


def dedup_nodes(rows: DataFrame) -> DataFrame:
    """One row per label.  A sample seen with several genomes keeps the last DAG's."""
    return rows.groupBy("g", "label").agg(
        F.any_value("kind").alias("kind"),
        F.any_value("sample_id").alias("sample_id"),
        F.max_by("cg", "dag_id").alias("cg"),
        F.any_value("key").alias("key"),
    )


def dedup_edges(rows: DataFrame) -> DataFrame:
    """One row per label pair with the least weight."""
    return rows.groupBy("g", "parent", "child").agg(
        F.min("edge_weight").alias("edge_weight"), F.any_value("key").alias("key")
    )


def dedup_root_edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g", "child").agg(F.min("edge_weight").alias("edge_weight"))


def clade_slots(rows: DataFrame) -> DataFrame:
    """(g, parent, key) -> clade_index, numbered as in the label's first source node."""
    return rows.groupBy("g", "parent", "key").agg(
        F.min_by("clade_index", F.struct("dag_id", "parent_id")).alias("clade_index")
    )


def indexed_edges(edges: DataFrame, slots: DataFrame) -> DataFrame:
    return edges.join(slots, ["g", "parent", "key"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merged nodes that no merged edge points at."""
    pointed = edges.select("g", F.col("child").alias("label"))
    return nodes.join(pointed, ["g", "label"], "left_anti")


def orphan_edges(nodes: DataFrame, edges: DataFrame, slots: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges that attach orphans: to every clade with exactly the orphan's
    leaves under a non-orphan parent, else to the pseudo-root."""
    loose = orphans(nodes, edges).select("g", F.col("label").alias("child"), "key", "kind")
    weighted = loose.join(roots, ["g", "child"], "left").withColumn(
        "edge_weight", F.coalesce("edge_weight", F.lit(0.0))
    )
    weighted = cut(weighted, "orphans")
    found = cut(weighted.join(slots, ["g", "key"]).where(F.col("parent") != F.col("child")), "homes")
    # orphans are few: only the homes found for them are looked up among the children
    pointed = edges.select("g", F.col("child").alias("parent")).join(
        found.select("g", "parent").distinct(), ["g", "parent"], "left_semi"
    )
    adopted = cut(found.join(pointed.distinct(), ["g", "parent"], "left_semi"), "adopted").select(
        "g", "parent", "child", "clade_index", "edge_weight"
    )
    lost = weighted.join(adopted.select("g", "child"), ["g", "child"], "left_anti").select(
        "g", F.lit(UA_LABEL).alias("parent"), "child",
        F.lit(0).cast(slots.schema["clade_index"].dataType).alias("clade_index"), "edge_weight"
    )
    return adopted.unionByName(lost)


def assemble(rows: Labelled) -> HistoryDag:
    nodes = cut(dedup_nodes(rows.nodes), "merged-nodes", ("kind",))
    edges = cut(indexed_edges(dedup_edges(rows.edges), clade_slots(rows.edges)), "merged-arcs")
    body = edges.select("g", "parent", "child", "clade_index", "edge_weight")
    slots = edges.select("g", "parent", "key", "clade_index").distinct()
    arcs = body.unionByName(
        orphan_edges(nodes, edges, slots, dedup_root_edges(rows.root_edges))
    )
    refs = cut(rows.refs.groupBy("g").agg(
        F.min_by("reference_id", "dag_id").alias("reference_id"),
        F.min_by("reference_seq", "dag_id").alias("reference_seq"),
    ), "refs")
    heads = nodes.where(F.col("kind") == "inner").select("g", F.col("label").alias("parent"), F.col("cg").alias("parent_cg"))
    genome = nodes.select("g", "label", "cg")
    none = F.array().cast(GENOME)
    full = (
        arcs.join(genome.withColumnsRenamed({"label": "child", "cg": "child_cg"}), ["g", "child"])
        .join(heads, ["g", "parent"], "left")
        .join(refs, "g")
        .select(
            F.col("g").alias("dag_id"),
            F.xxhash64("parent", "child").alias("edge_id"),
            F.col("parent").alias("parent_id"),
            F.col("child").alias("child_id"),
            "clade_index",
            edge_mutations(F.coalesce("parent_cg", none), "child_cg", "reference_seq").alias("mutations"),
            "edge_weight",
        )
    )
    ua = refs.select(
        F.col("g").alias("dag_id"), F.lit(UA_LABEL).alias("node_id"), F.lit("ua").alias("kind"),
        F.lit(None).cast("string").alias("sample_id"), none.alias("cg"),
    )
    body_nodes = nodes.select(
        F.col("g").alias("dag_id"), F.col("label").alias("node_id"), "kind", "sample_id", "cg"
    )
    return HistoryDag(body_nodes.unionByName(ua), full, refs.withColumnRenamed("g", "dag_id"))


def merge(
    dag: HistoryDag,
    group: Column | None = None,
    levels: EdgeLevels | None = None,
    consistent: bool = True,
) -> HistoryDag:
    """Merge all DAGs that share ``group`` (default: all of them) into one.

    ``consistent=False`` accepts inputs whose clade alternatives differ in
    leaves: leaf sets come from the closure and the result is trimmed.
    """
    group = F.lit("merged") if group is None else group
    levels = levels or leafsets.levels_with_leaves(dag)
    keys = leafsets.leaf_keys(levels) if consistent else leafsets.leaf_keys_exact(levels)
    rows = label(dag, keys, group)
    out = assemble(replace(rows, edges=cut(rows.edges, "arcs")))
    out = out.with_edges(cut(out.edges, "merged-edges"))
    return out if consistent else trim_inconsistent(out)[0]


def counters(rows: Labelled) -> DataFrame:
    """(g, nodes, edges) of the merge before orphans are adopted or clades trimmed."""
    nodes, edges = dedup_nodes(rows.nodes), dedup_edges(rows.edges)
    n = nodes.groupBy("g").agg((F.count(F.lit(1)) + 1).alias("nodes"))
    e = edges.groupBy("g").agg(F.count(F.lit(1)).alias("inner_edges"))
    r = orphans(nodes, edges).groupBy("g").agg(F.count(F.lit(1)).alias("root_edges"))
    return (
        n.join(e, "g", "left").join(r, "g", "left")
        .select("g", "nodes", (F.coalesce("inner_edges", F.lit(0)) + F.coalesce("root_edges", F.lit(0))).alias("edges"))
    )


def novel_nodes(
    fragment: HistoryDag, fragment_keys: leafsets.LeafKeys, known: leafsets.LeafKeys, origin: Column | None = None
) -> DataFrame:
    """(dag_id, novel): inner nodes of each fragment whose clade split its own merge lacks.

    ``origin`` names, from a fragment's ``dag_id``, the DAG of ``known`` that it
    came from; by default one of the same id.
    """
    origin = F.col("dag_id") if origin is None else origin
    inner = fragment.nodes.where(F.col("kind") == "inner").select("dag_id", "node_id").join(
        fragment_keys.nodes.select("dag_id", "node_id", "split"), ["dag_id", "node_id"]
    )
    seen = known.nodes.select(F.col("dag_id").alias("origin"), "split").distinct()
    new = inner.withColumn("origin", origin).join(seen, ["origin", "split"], "left_anti").groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("novel")
    )
    return (
        fragment.refs.select("dag_id").join(new, "dag_id", "left")
        .select("dag_id", F.coalesce("novel", F.lit(0)).alias("novel"))
    )
