"""Processing order of a DAG: layered edges, heights, depths, reachability.

Dynamic programs run one *level* at a time over all DAGs in the table at once.
A level is the set of edges whose parents have the same rank.  Two layouts:

* strict -- every inner child sits exactly one level below its parent (layered
  inputs; any tree ranked by depth).  The whole program is then one lazy plan.
* staged -- edges may skip levels.  Ranks are longest paths to a leaf and each
  edge is written once, partitioned by the rank of its child, so a level reads
  only the partition it needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.runtime import cut, stage_path
from cladeloom.schema import HistoryDag


@dataclass(frozen=True)
class Level:
    """Edges with parents of one rank; ``children`` is leaf, inner or mixed."""

    edges: DataFrame
    children: str = "mixed"


@dataclass(frozen=True)
class EdgeLevels:
    """Edges in processing order, bottom-up.  ``keys`` scope node ids."""

    keys: tuple[str, ...]
    levels: tuple[Level, ...] = ()
    # Staged layout: one table with parent_rank / child_rank, and the top rank.
    ranked: DataFrame | None = None
    height: int = 0
    cut_every: int = 0
    # Strict layouts of small groups: tasks to deal rows into by key; 0 leaves it to the session.
    tasks: int = 0

    def dealt(self, df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(self.tasks, *by) if self.tasks else df

    @property
    def strict(self) -> bool:
        return self.ranked is None


def layered(*levels: Level, keys: tuple[str, ...] = (), cut_every: int = 0) -> EdgeLevels:
    return EdgeLevels(keys, tuple(levels), None, len(levels), cut_every)


def _peel(arcs: DataFrame, start: DataFrame, name: str) -> DataFrame:
    """(dag_id, node_id, rank): longest path to each node along ``arcs`` (dag_id, node_id, next_id).

    A node is ranked once, in the round after the last of its incoming arcs was
    followed, and only then followed itself, so the rounds together write a
    row per node and per node that waits for more.  ``start`` holds the nodes
    without incoming arcs and their rank; a null rank marks a start whose paths
    do not count.  What never becomes free of incoming arcs lies on or behind a
    cycle.
    """
    spark = arcs.sparkSession
    path = stage_path(spark, name)
    ids = ["dag_id", "node_id"]
    need = arcs.groupBy("dag_id", "next_id").agg(F.count(F.lit(1)).alias("need"))
    arcs = cut(arcs.join(need, ["dag_id", "next_id"]).select(*ids, "next_id", "need"), name)
    schema = f"{', '.join(f'{c} {arcs.schema[c].dataType.simpleString()}' for c in ids)}, rank int, got bigint, need bigint"
    none = F.lit(0).cast("bigint")
    start.select(*ids, F.col("rank").cast("int").alias("rank"), none.alias("got"), none.alias("need")).write.parquet(f"{path}/round=0")
    i = 0
    while True:
        last = spark.read.schema(schema).parquet(f"{path}/round={i}")
        ready, waiting = last.where("got = need"), last.where("got < need")
        if ready.isEmpty():
            break
        came = ready.select(*ids, "rank").join(arcs, ids).select(
            "dag_id", F.col("next_id").alias("node_id"), (F.col("rank") + 1).alias("rank"), F.lit(1).cast("bigint").alias("got"), "need"
        )
        i += 1
        came.unionByName(waiting).groupBy(*ids).agg(
            F.max("rank").alias("rank"), F.sum("got").alias("got"), F.max("need").alias("need")
        ).write.parquet(f"{path}/round={i}")
    ranked = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).where("got = need")
    if not waiting.isEmpty() or ranked.where("got > 0").count() != arcs.select("dag_id", "next_id").distinct().count():
        raise ValueError(f"{name}: the graph has a cycle")
    return ranked.where("rank is not null").select(*ids, "rank")


def _ends(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without incoming arcs."""
    return nodes.select("dag_id", "node_id").join(
        arcs.select("dag_id", F.col("next_id").alias("node_id")), ["dag_id", "node_id"], "left_anti"
    )


def heights(dag: HistoryDag) -> DataFrame:
    """(dag_id, node_id, height): longest path down to a childless node."""
    arcs = dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("next_id"))
    start = _ends(arcs, dag.nodes).withColumn("rank", F.lit(0))
    return _peel(arcs, start, "heights").withColumnRenamed("rank", "height")


def depths(dag: HistoryDag) -> DataFrame:
    """(dag_id, node_id, depth): longest path from the root."""
    arcs = dag.edges.select("dag_id", F.col("parent_id").alias("node_id"), F.col("child_id").alias("next_id"))
    roots = dag.roots().select("dag_id", "node_id", F.lit(0).alias("rank"))
    start = _ends(arcs, dag.nodes).join(roots, ["dag_id", "node_id"], "left")
    return _peel(arcs, start, "depths").withColumnRenamed("rank", "depth")


def _stack(rounds: list[DataFrame], column: str) -> DataFrame:
    out = None
    for i, df in enumerate(rounds):
        one = df.withColumn(column, F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Distinct (dag_id, node_id) reachable from ``start`` along ``edges``.

    Each round joins only nodes not seen before, so cycles end by themselves.
    """
    e = edges.select("dag_id", "parent_id", "child_id")
    seen = frontier = cut(start.select("dag_id", "node_id").distinct(), "reach")
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        frontier = cut(
            frontier.withColumnRenamed("node_id", "parent_id")
            .join(e, ["dag_id", "parent_id"])
            .select("dag_id", F.col("child_id").alias("node_id"))
            .distinct()
            .join(seen, ["dag_id", "node_id"], "left_anti"),
            "reach",
        )
        seen = seen.unionByName(frontier)
        if rounds % 16 == 0:
            seen = cut(seen, "reach")
    return seen


def ancestors(dag: HistoryDag, max_up: int | None = None) -> DataFrame:
    """(dag_id, node_id, ancestor_id, up): proper ancestors, shortest distance."""
    e = dag.edges.select("dag_id", "parent_id", F.col("child_id"))
    first = e.select(
        "dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id")
    ).distinct()

    def step(df):
        return (
            df.withColumnRenamed("ancestor_id", "child_id")
            .join(e, ["dag_id", "child_id"])
            .select("dag_id", "node_id", F.col("parent_id").alias("ancestor_id"))
            .distinct()
        )

    rounds = [first]
    if max_up is None:
        rounds = [cut(first, "ancestors")]
        while not rounds[-1].isEmpty():
            rounds.append(cut(step(rounds[-1]), "ancestors"))
    else:
        for _ in range(max_up - 1):
            rounds.append(step(rounds[-1]))
    return (
        _stack(rounds, "up")
        .groupBy("dag_id", "node_id", "ancestor_id")
        .agg((F.min("up") + 1).alias("up"))
    )


def lca(dag: HistoryDag, pairs: DataFrame) -> DataFrame:
    """Adds ``lca_id`` to (dag_id, a_id, b_id): the deepest common ancestor-or-self in a tree.

    Jump pointers over 1, 2, 4, ... steps lift the deeper end to the other's
    depth and then both ends to just below where they meet: joins on the pairs
    alone, as many as the depth has binary digits, twice.
    """
    deep = cut(depths(dag), "depths")
    ids = ["dag_id", "node_id"]
    top = deep.agg(F.max("depth")).first()[0] or 0
    jumps = [cut(dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("up")), "jump")]
    while 2 ** len(jumps) <= top:
        last = jumps[-1]
        further = last.select("dag_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        jumps.append(cut(last.join(further, ["dag_id", "up"]).select("dag_id", "node_id", F.col("next").alias("up")), "jump"))

    def lifted(df: DataFrame, jump: DataFrame, end: str) -> DataFrame:
        renamed = jump.select("dag_id", F.col("node_id").alias(end), F.col("up").alias(f"{end}_up"))
        return df.join(renamed, ["dag_id", end], "left")

    known = pairs.select("dag_id", "a_id", "b_id").distinct()
    at = known.withColumns({"a": F.col("a_id"), "b": F.col("b_id")})
    for end in ("a", "b"):
        at = at.join(deep.withColumnsRenamed({"node_id": end, "depth": f"{end}_depth"}), ["dag_id", end])
    for k in range(len(jumps) - 1, -1, -1):
        for end, other in (("a", "b"), ("b", "a")):
            climb = F.col(f"{end}_depth") - F.col(f"{other}_depth") >= 2**k
            at = lifted(at, jumps[k], end).withColumns(
                {
                    end: F.when(climb, F.col(f"{end}_up")).otherwise(F.col(end)),
                    f"{end}_depth": F.when(climb, F.col(f"{end}_depth") - 2**k).otherwise(F.col(f"{end}_depth")),
                }
            ).drop(f"{end}_up")
        at = cut(at, "level")
    for k in range(len(jumps) - 1, -1, -1):
        at = lifted(lifted(at, jumps[k], "a"), jumps[k], "b")
        apart = F.col("a_up").isNotNull() & F.col("b_up").isNotNull() & (F.col("a_up") != F.col("b_up"))
        at = cut(
            at.withColumns({e: F.when(apart, F.col(f"{e}_up")).otherwise(F.col(e)) for e in ("a", "b")}).drop("a_up", "b_up"), "below"
        )
    at = lifted(at, jumps[0], "a")
    return at.select("dag_id", "a_id", "b_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a_up")).alias("lca_id"))


def rank_edges(dag: HistoryDag, edges: DataFrame | None = None) -> EdgeLevels:
    """Staged layout: every edge with the ranks of both ends."""
    # Childless nodes, mostly by far the most, have rank 0 and need no lookup.
    h = cut(heights(dag).where(F.col("height") > 0), "height")
    edges = dag.edges if edges is None else edges
    ranked = (
        edges.join(
            h.withColumnRenamed("node_id", "parent_id").withColumnRenamed("height", "parent_rank"),
            ["dag_id", "parent_id"],
        ).join(
            h.withColumnRenamed("node_id", "child_id").withColumnRenamed("height", "child_rank"),
            ["dag_id", "child_id"], "left",
        ).withColumn("child_rank", F.coalesce("child_rank", F.lit(0)))
    )
    ranked = cut(ranked, "ranked", ("child_rank",))
    top = ranked.agg(F.max("parent_rank")).first()[0] or 0
    return EdgeLevels(("dag_id",), (), ranked, top)


def tree_levels(edges: DataFrame, max_depth: int, keys=("dag_id",), cut_every: int = 8) -> EdgeLevels:
    """Strict layout of a tree whose edges carry ``parent_depth`` and ``leaf_child``."""
    levels = [
        Level(edges.where(F.col("parent_depth") == d)) for d in range(max_depth - 1, -1, -1)
    ]
    return EdgeLevels(tuple(keys), tuple(levels), None, max_depth, cut_every)
