"""Logical schemas and the three-table container every operator works on.

A history DAG is stored long, many DAGs per table, separated by ``dag_id``:

* ``nodes`` one row per node.  ``kind`` is ``ua`` (the pseudo-root carrying the
  reference sequence), ``inner`` or ``leaf``; ``cg`` holds only the sites at
  which the node's genome differs from the reference.
* ``edges`` one row per edge.  Edges of one parent that share ``clade_index``
  are alternatives; a tree picks exactly one per clade.
* ``refs`` one row per DAG.

``node_id`` may be BIGINT (loaded data) or STRING (content labels after a
merge); no operator depends on which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE = T.StructType(
    [T.StructField("pos", T.IntegerType()), T.StructField("base", T.StringType())]
)
MUTATION = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("par", T.StringType()),
        T.StructField("mut", T.StringType()),
    ]
)
GENOME = T.ArrayType(SITE)
MUTATIONS = T.ArrayType(MUTATION)


def node_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("dag_id", T.StringType()),
            T.StructField("node_id", id_type or T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("sample_id", T.StringType()),
            T.StructField("cg", GENOME),
        ]
    )


def edge_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("dag_id", T.StringType()),
            T.StructField("edge_id", T.LongType()),
            T.StructField("parent_id", id_type or T.LongType()),
            T.StructField("child_id", id_type or T.LongType()),
            T.StructField("clade_index", T.IntegerType()),
            T.StructField("mutations", MUTATIONS),
            T.StructField("edge_weight", T.DoubleType()),
        ]
    )


REFS = T.StructType(
    [
        T.StructField("dag_id", T.StringType()),
        T.StructField("reference_id", T.StringType()),
        T.StructField("reference_seq", T.StringType()),
    ]
)

UA, INNER, LEAF = "ua", "inner", "leaf"


@dataclass(frozen=True)
class HistoryDag:
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame

    @property
    def spark(self):
        return self.edges.sparkSession

    def roots(self) -> DataFrame:
        """Nodes that no edge points at."""
        kids = self.edges.select("dag_id", F.col("child_id").alias("node_id"))
        return self.nodes.join(kids, ["dag_id", "node_id"], "left_anti")

    def union(self, other: "HistoryDag") -> "HistoryDag":
        return HistoryDag(
            self.nodes.unionByName(other.nodes, allowMissingColumns=True),
            self.edges.unionByName(other.edges, allowMissingColumns=True),
            self.refs.unionByName(other.refs),
        )

    def with_edges(self, edges: DataFrame) -> "HistoryDag":
        return HistoryDag(self.nodes, edges, self.refs)

    def with_nodes(self, nodes: DataFrame) -> "HistoryDag":
        return HistoryDag(nodes, self.edges, self.refs)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Native sink: three Parquet tables under ``path``."""
        for name in ("nodes", "edges", "refs"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> "HistoryDag":
        return HistoryDag(
            *(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "refs"))
        )
