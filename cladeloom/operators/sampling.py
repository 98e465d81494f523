"""Choosing trees: reproducible draws, one alternative per clade.

Every draw is a function of (seed, draw number, edge), so a rerun or a lost
executor repeats it.  Choices are aggregates (``min_by``), not windows: a clade
with very many alternatives reduces map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.numbers import uniform_draw
from cladeloom.runtime import cut
from cladeloom.schema import HistoryDag


def edge_uniform_key(seed: int, draw: Column, *edge_id: str) -> Column:
    """Ordering key under which every alternative is equally likely."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), *[F.col(c).cast("string") for c in edge_id]))


def weighted_key(seed: int, draw: Column, weight: Column, *edge_id: str) -> Column:
    """Exponential clock: the smallest key falls on an edge in proportion to its
    weight; a clade whose weights are all zero falls back to even odds."""
    u = uniform_draw(F.lit(str(seed)), draw.cast("string"), *[F.col(c).cast("string") for c in edge_id])
    tick = -F.log(u)
    return F.when(weight > 0, F.struct(F.lit(0), tick / weight)).otherwise(F.struct(F.lit(1), tick))


def log_weighted_key(seed: int, draw: Column, log_weight: Column, *edge_id: str) -> Column:
    """``weighted_key`` for weights given by their logarithms, however large."""
    u = uniform_draw(F.lit(str(seed)), draw.cast("string"), *[F.col(c).cast("string") for c in edge_id])
    return F.log(-F.log(u)) - log_weight


def choose(edges: DataFrame, by: list[str], key: Column, keep: list[str]) -> DataFrame:
    """One edge per clade and draw, the one with the least key."""
    return edges.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("e")).select(*by, "e.*")


def sample_edges(
    edges: DataFrame,
    roots: DataFrame,
    draws: DataFrame,
    key_of,
    rounds: int | None = None,
) -> DataFrame:
    """(draw, dag_id, parent_id, child_id, clade_index, ...) of the sampled trees.

    Walks down from ``roots`` (dag_id, node_id) and draws only at nodes a tree
    has reached.  ``draws`` has (dag_id, draw); ``key_of(draw)`` gives the
    ordering key.  ``rounds`` bounds the walk lazily where the depth is known.
    """
    by = ["draw", "dag_id", "parent_id", "clade_index"]
    keep = [c for c in edges.columns if c not in by]
    front = roots.join(draws, "dag_id").select("draw", "dag_id", "node_id")
    parts, i = [], 0
    while rounds is None or i < rounds:
        live = front.withColumnRenamed("node_id", "parent_id").join(edges, ["dag_id", "parent_id"])
        picked = choose(live, by, key_of(F.col("draw")), keep)
        if rounds is None:
            picked = cut(picked, "sample")
            if picked.isEmpty():
                break
        parts.append(picked)
        front = picked.select("draw", "dag_id", F.col("child_id").alias("node_id"))
        i += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_trees(dag: HistoryDag, picked: DataFrame) -> HistoryDag:
    """Sampled edges as one tree per draw, ``dag_id`` = ``<dag>#<draw>``."""
    name = F.concat_ws("#", "dag_id", F.col("draw").cast("string"))
    named = picked.withColumn("tree", name)
    heads = named.select("dag_id", "tree", F.col("child_id").alias("node_id"))
    roots = dag.nodes.where("kind = 'ua'").select("dag_id", "node_id")
    all_nodes = heads.unionByName(
        named.select("dag_id", "tree").distinct().join(roots, "dag_id").select("dag_id", "tree", "node_id")
    )
    nodes = dag.nodes.join(all_nodes, ["dag_id", "node_id"]).drop("dag_id").withColumnRenamed("tree", "dag_id")
    cols = [c for c in dag.edges.columns if c != "dag_id"]
    edges = named.select(F.col("tree").alias("dag_id"), *cols)
    refs = dag.refs.join(named.select("dag_id", "tree").distinct(), "dag_id").drop("dag_id").withColumnRenamed(
        "tree", "dag_id"
    )
    return HistoryDag(nodes, edges, refs)


METHODS = ("random", "parsimony", "parsimony-ua-free", "edge-weight", "ml", "rf-min", "rf-max")


@dataclass(frozen=True)
class SamplePlan:
    """How to draw: which weight decides optimality, and whether trees (rather
    than alternatives) are equally likely."""

    method: str = "parsimony"
    uniform: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown sampling method {self.method!r}; one of {', '.join(METHODS)}")

