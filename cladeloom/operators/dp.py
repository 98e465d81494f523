"""Downward and upward dynamic programs over edge levels.

``below`` computes, per node, the semiring value of its sub-DAG; ``above`` turns
an additive result into the best total weight of any tree through each edge.
Both touch every edge once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT, fold_factors, ties_with_best
from cladeloom.operators.levels import EdgeLevels, Level
from cladeloom.operators.semiring import Semiring, TreeCount
from cladeloom.runtime import cut, stage_path


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass(frozen=True)
class Below:
    """Per level, bottom-up: weighed edges, clade values and node values."""

    levels: EdgeLevels
    ops: Semiring
    edge_parts: tuple[DataFrame, ...]
    clade_parts: tuple[DataFrame, ...]
    node_parts: tuple[DataFrame, ...]

    @property
    def keys(self) -> list[str]:
        return list(self.levels.keys)

    @property
    def nodes(self) -> DataFrame:
        return _union(list(self.node_parts))

    @property
    def clades(self) -> DataFrame:
        return _union(list(self.clade_parts))

    @property
    def edges(self) -> DataFrame:
        return _union(list(self.edge_parts))

    @property
    def top(self) -> DataFrame:
        """Values of the roots."""
        if self.levels.strict:
            return self.node_parts[-1]
        return self.nodes.join(
            _roots(self.levels).drop("parent_rank"), [*self.keys, "node_id"], "left_semi"
        )

    def best_edges(self) -> DataFrame:
        """Edges on which a clade attains its best weight."""
        return _union(
            [best_of(e, c, self.keys, self.ops) for e, c in zip(self.edge_parts, self.clade_parts)]
        )


def _roots(levels: EdgeLevels) -> DataFrame:
    keys = list(levels.keys)
    parents = levels.ranked.select(
        *keys, F.col("parent_id").alias("node_id"), "parent_rank"
    ).distinct()
    children = levels.ranked.select(*keys, F.col("child_id").alias("node_id"))
    return parents.join(children, [*keys, "node_id"], "left_anti")


def _start_above(result: Below, start) -> tuple[DataFrame, DataFrame | None]:
    """Top-level roots with the start value, and (staged only) the roots of each rank."""
    keys = result.keys
    if result.levels.strict:
        return result.node_parts[-1].select(*keys, "node_id", start), None
    roots = cut(_roots(result.levels).select("*", start.alias("start")), "roots")
    return roots, roots


def _entering(result: Below, rank: int, roots, pending, total, name: str) -> DataFrame:
    """Upward values of the nodes of one rank: its roots plus what came down."""
    keys = result.keys
    own = roots.where(F.col("parent_rank") == rank).select(
        *keys, "node_id", F.col("start").alias(name)
    )
    if not pending:
        return own
    came = _union([p.where(F.col("child_rank") == rank) for p in pending])
    return cut(own.unionByName(_meet(came, keys, total, name)), "above")


def _meet(came: DataFrame, keys, total, name: str) -> DataFrame:
    return came.groupBy(*keys, F.col("child_id").alias("node_id")).agg(total.alias(name))


def best_of(edges: DataFrame, clades: DataFrame, keys: list[str], ops: Semiring) -> DataFrame:
    by = [*keys, "parent_id", "clade_index"]
    held = clades.select(*by, F.col("w").alias("clade_w"))
    if getattr(ops, "tolerant", False):
        keep = ties_with_best(F.col("w"), F.col("clade_w"))
    else:
        keep = F.col("w") == F.col("clade_w")
    return edges.join(held, by).where(keep)


def _weigh_leaves(df: DataFrame, ops: Semiring) -> DataFrame:
    return ops.lift(df.withColumns({**ops.edge(), **ops.leaf()}))


def _weigh_inner(df: DataFrame, done: DataFrame, keys: list[str], ops: Semiring) -> DataFrame:
    child = done.select(
        *keys, F.col("node_id").alias("child_id"), *ops.values
    )
    return ops.lift(df.withColumns(ops.edge()).join(child, [*keys, "child_id"]))


def _arrive(level: Level, done: DataFrame | None, keys, ops) -> DataFrame:
    if level.children == "leaf":
        return _weigh_leaves(level.edges, ops)
    if level.children == "inner":
        return _weigh_inner(level.edges, done, keys, ops)
    leaves = _weigh_leaves(level.edges.where(F.col("leaf_child")), ops)
    if done is None:
        return leaves
    inner = _weigh_inner(level.edges.where(~F.col("leaf_child")), done, keys, ops)
    return leaves.unionByName(inner)


def _combine(arrived: DataFrame, keys, ops: Semiring) -> tuple[DataFrame, DataFrame]:
    by_node = [*keys, "parent_id"]
    clades = ops.within(arrived, [*by_node, "clade_index"])
    nodes = ops.between(clades, by_node).withColumnRenamed("parent_id", "node_id")
    return clades, nodes


def below(levels: EdgeLevels, ops: Semiring, keep: bool = False) -> Below:
    """Values of all levels; ``keep`` writes every level's parts, for runs that go up again."""
    if levels.strict:
        return _below_strict(levels, ops, keep)
    return _below_staged(levels, ops)


def _below_strict(levels: EdgeLevels, ops: Semiring, keep: bool = False) -> Below:
    keys = list(levels.keys)
    edge_parts, clade_parts, node_parts = [], [], []
    done = None
    by_node = [*keys, "parent_id"]
    for i, level in enumerate(levels.levels, 1):
        if levels.tasks and level.children == "inner":
            level = replace(level, edges=levels.dealt(level.edges, *keys, "child_id"))
        arrived = _arrive(level, done, keys, ops)
        if keep:
            # read again by the upward pass: edges and clades once each per level; leaf edges are as they came
            if level.children != "leaf":
                arrived = cut(arrived, "arrived")
            clades = cut(ops.within(levels.dealt(arrived, *by_node), [*by_node, "clade_index"]), "clades")
            done = ops.between(levels.dealt(clades, *by_node), by_node).withColumnRenamed("parent_id", "node_id")
            done = levels.dealt(cut(done, "nodes"), *keys, "node_id")
        else:
            clades, done = _combine(levels.dealt(arrived, *by_node), keys, ops)
            if levels.cut_every and i % levels.cut_every == 0:
                done = cut(done, "below")
        edge_parts.append(arrived)
        clade_parts.append(clades)
        node_parts.append(done)
    return Below(levels, ops, tuple(edge_parts), tuple(clade_parts), tuple(node_parts))


def _below_staged(levels: EdgeLevels, ops: Semiring) -> Below:
    """Each weighed edge is written once, under the rank of its parent."""
    keys = list(levels.keys)
    ranked = levels.ranked
    spark = ranked.sparkSession
    path = stage_path(spark, "arrivals")
    node_parts, clade_parts, edge_parts = [], [], []

    def push(df: DataFrame, step: int) -> None:
        df.write.partitionBy("parent_rank").parquet(f"{path}/step={step}")

    first = _weigh_leaves(ranked.where(F.col("child_rank") == 0), ops)
    push(first, 0)
    arrivals_schema = first.schema
    for rank in range(1, levels.height + 1):
        arrived = (
            spark.read.schema(arrivals_schema).option("basePath", path)
            .parquet(*[f"{path}/step={s}" for s in range(rank)])
            .where(F.col("parent_rank") == rank)
        )
        clades = cut(ops.within(arrived, [*keys, "parent_id", "clade_index"]), "clades")
        nodes = ops.between(clades, [*keys, "parent_id"])
        nodes = cut(nodes.withColumnRenamed("parent_id", "node_id"), "nodes")
        edge_parts.append(arrived)
        clade_parts.append(clades)
        node_parts.append(nodes)
        if rank < levels.height:
            waiting = ranked.where(F.col("child_rank") == rank)
            push(_weigh_inner(waiting, nodes, keys, ops).select(*arrivals_schema.names), rank)
    return Below(levels, ops, tuple(edge_parts), tuple(clade_parts), tuple(node_parts))


def _slack(result: Below, i: int, above_nodes: DataFrame) -> DataFrame:
    """Per clade: weight of the best tree outside it, through its parent."""
    keys, dealt = result.keys, result.levels.dealt
    by_node = [*keys, "parent_id"]
    totals = result.node_parts[i].select(
        *keys, F.col("node_id").alias("parent_id"), F.col("w").alias("node_w")
    )
    up = above_nodes.select(*keys, F.col("node_id").alias("parent_id"), "above_w")
    clades = result.clade_parts[i].select(*by_node, "clade_index", F.col("w").alias("clade_w"))
    return (
        dealt(clades, *by_node)
        .join(totals, by_node)
        .join(dealt(up, *by_node), by_node)
        .withColumn("outside", F.col("above_w") + F.col("node_w") - F.col("clade_w"))
        .select(*keys, "parent_id", "clade_index", "outside", "clade_w")
    )


@dataclass(frozen=True)
class Above:
    """Parts run top-down; staged runs have one node part per rank."""

    edge_parts: tuple[DataFrame, ...]
    node_parts: tuple[DataFrame, ...]

    @property
    def edges(self) -> DataFrame:
        return _union(list(self.edge_parts))

    @property
    def nodes(self) -> DataFrame:
        return _union(list(self.node_parts))


def above(result: Below) -> Above:
    """Best total weight through every edge, and the weight above every node.

    Valid for additive weights only.  ``edges`` gains ``through_w``.
    """
    ops = result.ops
    if not ops.additive:
        raise ValueError("the upward pass needs an additive weight")
    keys = result.keys
    pick = F.max if getattr(ops, "largest", False) else F.min
    total = pick("above_child")
    zero = F.lit(0).cast(ops.dtype)
    up, roots = _start_above(result, zero.alias("above_w"))
    staged = roots is not None
    pending: list[DataFrame] = []
    edge_parts, node_parts = [], [] if staged else [up]
    for i in range(len(result.node_parts) - 1, -1, -1):
        if staged:
            up = _entering(result, i + 1, roots, pending, total, "above_w")
            node_parts.append(up)
        by = [*keys, "parent_id", "clade_index"]
        through = (
            result.levels.dealt(result.edge_parts[i], *by)
            .join(result.levels.dealt(_slack(result, i, up), *by), by)
            .withColumn("through_w", F.col("outside") + F.col("w"))
            .withColumn("above_child", F.col("outside") + F.col("edge_w"))
        )
        if staged:
            through = cut(through, "through", ("child_rank",))
            pending.append(through)
        elif i > 0:
            up = _meet(through, keys, total, "above_w")
            node_parts.append(up)
        edge_parts.append(through)
    if staged:
        leaves = _union([p.where(F.col("child_rank") == 0) for p in pending])
        node_parts.append(_meet(leaves, keys, total, "above_w"))
    else:
        node_parts.append(_meet(edge_parts[-1], keys, total, "above_w"))
    return Above(tuple(edge_parts), tuple(node_parts))


def edge_penalties(result: Below, through: DataFrame, rel_zero: float | None = None) -> DataFrame:
    """How much worse than the optimum the best tree through each edge is.

    ``rel_zero`` rounds a penalty within that share of the optimum to zero.
    """
    keys = result.keys
    optimum = (
        result.top.groupBy(*keys).agg(F.min("w").alias("best_w"))
        if keys
        else None
    )
    df = through.join(optimum, keys) if keys else through
    pen = F.col("through_w") - F.col("best_w")
    if rel_zero is not None:
        slack = F.lit(rel_zero) * F.greatest(F.lit(1.0), F.abs("best_w"))
        pen = F.when(F.abs(pen) <= slack, F.lit(0.0)).otherwise(pen)
        pen = F.when(pen < 0, F.raise_error(F.lit("negative edge penalty"))).otherwise(pen)
    return df.withColumn("penalty", pen)


def penalty_summary(penalties: DataFrame, by: list[str]) -> DataFrame:
    return penalties.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("penalty") == 0).alias("zero"),
        F.count_if(F.col("penalty") > 0).alias("positive"),
        F.max("penalty").alias("largest"),
    )


def _leave_one_out(factors, n):
    """Product of all factors but one equal to ``n``."""
    rest = F.transform(
        factors, lambda x: F.struct(x["f"], (x["m"] - F.when(x["f"] == n, 1).otherwise(0)).alias("m"))
    )
    return fold_factors(F.filter(rest, lambda x: x["m"] > 0))


def above_counts(result: Below) -> DataFrame:
    """(keys, node_id, above_n): trees of the DAG with the part below a node cut off."""
    return _union(_above_count_parts(result))


def above_counts_of_level(result: Below, depth: int) -> DataFrame:
    """``above_counts`` of the nodes ``depth`` levels under the roots (strict levels)."""
    return _above_count_parts(result)[depth]


def _above_count_parts(result: Below) -> list[DataFrame]:
    if not isinstance(result.ops, TreeCount):
        raise ValueError("above_counts needs a tree-count result")
    keys = result.keys
    total = F.try_sum("part").cast(COUNT)
    up, roots = _start_above(result, F.lit(1).cast(COUNT).alias("above_n"))
    staged = roots is not None
    pending, node_parts = [], [] if staged else [up]
    for i in range(len(result.node_parts) - 1, -1, -1):
        if staged:
            up = _entering(result, i + 1, roots, pending, total, "above_n")
            node_parts.append(up)
        own = result.node_parts[i].select(*keys, F.col("node_id").alias("parent_id"), "factors")
        ups = up.select(*keys, F.col("node_id").alias("parent_id"), "above_n")
        others = _leave_one_out(F.col("factors"), F.col("n"))
        outside = (
            result.clade_parts[i]
            .join(own, [*keys, "parent_id"])
            .join(ups, [*keys, "parent_id"])
            .select(
                *keys, "parent_id", "clade_index",
                F.try_multiply("above_n", others).cast(COUNT).alias("part"),
            )
        )
        rank = ["child_rank"] if staged else []
        part = (
            result.edge_parts[i]
            .select(*keys, "parent_id", "clade_index", "child_id", *rank)
            .join(outside, [*keys, "parent_id", "clade_index"])
        )
        if staged:
            part = cut(part, "above_n", ("child_rank",))
            pending.append(part)
        else:
            up = _meet(part, keys, total, "above_n")
            node_parts.append(up)
    if staged:
        leaves = _union([p.where(F.col("child_rank") == 0) for p in pending])
        node_parts.append(_meet(leaves, keys, total, "above_n"))
    return node_parts
