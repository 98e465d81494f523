"""Merging trees as they arrive.

A merge is a keyed minimum over content labels, so the state is just an
append-only log of labelled rows: every micro-batch writes its own folder
(rewritten whole on a retry, hence exactly once) and the merged DAG is built
when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.operators import leafsets, merge
from cladeloom.runtime import cut, materialise
from cladeloom.schema import HistoryDag
from cladeloom.sources import build, newick

TABLES = ("nodes", "edges", "root_edges", "refs")


def add(dag: HistoryDag, path: str, batch_id: int, group: str = "merged") -> None:
    """Append the labels of ``dag`` as one batch; a repeated id replaces it."""
    keys = leafsets.leaf_keys(leafsets.levels_with_leaves(dag))
    rows = merge.label(dag, keys, F.lit(group))
    for name in TABLES:
        getattr(rows, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def current(spark: SparkSession, path: str) -> HistoryDag:
    """The merge of everything added so far."""
    rows = merge.Labelled(*(spark.read.parquet(f"{path}/{n}").drop("batch") for n in TABLES))
    return materialise(merge.assemble(rows), "merged")


def follow_newick(spark: SparkSession, folder: str, sequences: DataFrame, reference: str, path: str):
    """A stream writer that adds every new Newick file of ``folder`` to the log.

    ``sequences`` (name, sequence).  Call ``.start()`` on the result.
    """
    stream = spark.readStream.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("dag_id"), F.col("value").alias("newick")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = cut(newick.parse_newick(batch), "newick")
        if rows.isEmpty():
            return
        dag = build.with_sequences(build.topology(rows, reference), sequences, reference)
        add(build.fitch_assign(dag.with_nodes(cut(dag.nodes, "nodes"))), path, batch_id)

    return stream.writeStream.foreachBatch(run)
