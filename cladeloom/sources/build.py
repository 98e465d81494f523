"""Trees from Newick topologies plus sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.bases import clean_sequence, genome_from_sequence
from cladeloom.operators.fitch import fitch_assign
from cladeloom.runtime import cut
from cladeloom.schema import GENOME, MUTATIONS, HistoryDag
from cladeloom.sources import fasta, newick

UA_ID = -1


def topology(rows: DataFrame, reference: str) -> HistoryDag:
    """Parsed Newick rows as trees under a pseudo-root; genomes still empty."""
    none = F.array().cast(GENOME)
    heads = rows.where(F.col("parent_id").isNotNull()).select(
        "dag_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("has_kids")
    ).distinct()
    nodes = rows.join(heads, ["dag_id", "node_id"], "left").select(
        "dag_id", "node_id", F.when(F.col("has_kids"), "inner").otherwise("leaf").alias("kind"),
        F.when(F.col("has_kids").isNull(), F.col("label")).alias("sample_id"), none.alias("cg"),
    )
    dags = rows.where(F.col("parent_id").isNull()).select("dag_id")
    ua = dags.select(
        "dag_id", F.lit(UA_ID).cast("bigint").alias("node_id"), F.lit("ua").alias("kind"),
        F.lit(None).cast("string").alias("sample_id"), none.alias("cg"),
    )
    edges = rows.select(
        "dag_id", F.col("node_id").alias("edge_id"),
        F.coalesce("parent_id", F.lit(UA_ID).cast("bigint")).alias("parent_id"),
        F.col("node_id").alias("child_id"), "clade_index",
        F.array().cast(MUTATIONS).alias("mutations"), F.lit(0.0).alias("edge_weight"),
    )
    refs = dags.select("dag_id", F.lit("").alias("reference_id"), F.lit(reference).alias("reference_seq"))
    return HistoryDag(nodes.unionByName(ua), edges, refs)


def with_sequences(dag: HistoryDag, sequences: DataFrame, reference: str) -> HistoryDag:
    """Leaf genomes from ``sequences`` (name, sequence)."""
    ref = clean_sequence(F.lit(reference))
    cg = genome_from_sequence(clean_sequence("sequence"), ref)
    known = sequences.select(F.col("name").alias("sample_id"), cg.cast(GENOME).alias("seq_cg"))
    nodes = dag.nodes.join(known, "sample_id", "left").withColumn(
        "cg", F.coalesce("seq_cg", "cg")
    ).select(*dag.nodes.columns)
    return dag.with_nodes(nodes)


def from_fasta_newick(spark: SparkSession, fasta_paths, newick_paths, reference: str, pattern: str | None = None) -> HistoryDag:
    """One tree per Newick file over the FASTA sequences, inner genomes by Fitch."""
    seqs = fasta.last_by_name(fasta.read_fasta(spark, fasta_paths))
    rows = cut(newick.parse_newick(newick.read_newick(spark, newick_paths, pattern)), "newick")
    dag = with_sequences(topology(rows, reference), seqs, reference)
    return fitch_assign(dag.with_nodes(cut(dag.nodes, "nodes")))
