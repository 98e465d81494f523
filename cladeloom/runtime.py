"""Lineage cutting for iterative jobs.

Level-by-level programs would otherwise grow a plan per round.  ``cut`` writes
the round's result as Parquet under the shared checkpoint folder and reads it
back: the data survives executor loss, keeps column pruning and partition
pruning, and carries true sizes, so later joins broadcast only what the
session's ``spark.sql.autoBroadcastJoinThreshold`` allows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = configured or sc.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    made = tempfile.mkdtemp(prefix="cladeloom-")
    sc.setCheckpointDir(made)
    return made


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores ahead of costly expressions.

    Large inputs already come in more files' splits than there are cores and
    stay as they are; only a table of a few small files is dealt out round-robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Rows of a task, about, where tables are dealt out by a key.
TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def materialise(dag, name: str = "dag"):
    """The same DAG with nodes and edges written and read back.

    Level-wise operators read their edges once per level, so operators that
    build a new DAG hand it over in this form.
    """
    return type(dag)(cut(dag.nodes, f"{name}-nodes"), cut(dag.edges, f"{name}-edges"), dag.refs)
