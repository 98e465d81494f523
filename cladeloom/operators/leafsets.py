"""Leaf sets below nodes and clades.

Two forms.  ``leaf_keys`` folds set keys upward in linear time; it is exact as
long as all alternatives of a clade cover the same leaves, and raises when they
do not.  ``leaf_bits`` holds any DAG's sets as bitmaps, a row per node and chunk
of leaves.  ``leaf_closure`` lists (node, leaf) pairs where names are needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.functions.setkeys import set_key, singleton_key, union_keys
from cladeloom.operators import dp
from cladeloom.operators.levels import EdgeLevels, rank_edges
from cladeloom.operators.semiring import Semiring
from cladeloom.runtime import cut
from cladeloom.schema import HistoryDag


def with_leaf_names(dag: HistoryDag) -> DataFrame:
    """Edges plus ``leaf_name``, the identity of a childless child (else NULL)."""
    leaves = dag.nodes.where(F.col("kind") == "leaf").select(
        "dag_id",
        F.col("node_id").alias("child_id"),
        F.coalesce("sample_id", F.col("node_id").cast("string")).alias("leaf_name"),
    )
    return dag.edges.join(leaves, ["dag_id", "child_id"], "left")


@dataclass(frozen=True)
class _LeafKeys(Semiring):
    values = ("key",)

    def leaf(self):
        return {"key": singleton_key(F.col("leaf_name"))}

    def within(self, df, by):
        lo, hi = F.min("key"), F.max("key")
        return (
            df.groupBy(*by)
            .agg(lo.alias("lo"), hi.alias("hi"))
            .select(
                *by,
                F.when(F.col("lo") == F.col("hi"), F.col("lo"))
                .otherwise(F.raise_error(F.lit("alternatives of a clade differ in leaves")))
                .alias("key"),
            )
        )

    def between(self, df, by):
        return df.groupBy(*by).agg(
            union_keys(F.col("key")).alias("key"), set_key(F.col("key")).alias("split")
        )


@dataclass(frozen=True)
class _Closure(Semiring):
    values = ("leaf",)

    def leaf(self):
        return {"leaf": F.col("leaf_name")}

    def within(self, df, by):
        return df.select(*by, "leaf").distinct()

    def between(self, df, by):
        return df.select(*by, "leaf").distinct()


@dataclass(frozen=True)
class _Bits(Semiring):
    """Bitmaps: ``chunk`` names a run of numbered leaves, ``bits`` has one bit for each."""

    values = ("chunk", "bits")

    def leaf(self):
        return {"chunk": F.col("leaf_chunk"), "bits": F.col("leaf_bit")}

    def within(self, df, by):
        return df.groupBy(*by, "chunk").agg(F.bit_or("bits").alias("bits"))

    def between(self, df, by):
        return df.groupBy(*by, "chunk").agg(F.bit_or("bits").alias("bits"))


#: Leaves of a chunk, and leaves that one task numbers, about.
CHUNK, NUMBERED = 63, 1 << 12


def with_leaf_bits(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with ``leaf_name`` plus the chunk and bit of that leaf.

    Leaves are numbered within each of ``keys`` by their first parent, so that
    neighbours share chunks, in parts that grow in number with the leaves.
    """
    named = edges.where(F.col("leaf_name").isNotNull())
    homes = cut(named.groupBy(*keys, "leaf_name").agg(F.min("parent_id").alias("home")), "leaf-homes")
    size = F.count(F.lit(1)).alias("size")
    sized = homes.join(homes.groupBy(*keys).agg(size), keys) if keys else homes.withColumn("size", F.lit(homes.count()))
    part = F.pmod(F.xxhash64("home"), F.ceil(F.col("size") / NUMBERED)).alias("part")
    order = Window.partitionBy(*keys, "part").orderBy("home", "leaf_name")
    place = (F.row_number().over(order) - 1).cast("bigint").alias("place")
    numbered = sized.select(*keys, "leaf_name", "home", part).select(*keys, "leaf_name", "part", place).select(
        *keys, "leaf_name", F.struct("part", F.floor(F.col("place") / CHUNK).alias("run")).alias("leaf_chunk"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % CHUNK).cast("int")).alias("leaf_bit"),
    )
    return edges.join(cut(numbered, "leaf-bits"), [*keys, "leaf_name"], "left")


def leaf_bits(levels: EdgeLevels) -> dp.Below:
    """Leaf sets of arriving edges, clades and nodes as (chunk, bits) rows; edges come from ``with_leaf_bits``."""
    return dp.below(levels, _Bits())


def levels_with_bits(dag: HistoryDag) -> EdgeLevels:
    return rank_edges(dag, with_leaf_bits(with_leaf_names(dag), ["dag_id"]))


@dataclass(frozen=True)
class LeafKeys:
    """``nodes``: inner nodes with ``key`` (their leaves) and ``split`` (their
    clades); ``edges``: every edge with the ``key`` of its child; ``clades``:
    (parent_id, clade_index, key)."""

    nodes: DataFrame
    edges: DataFrame
    clades: DataFrame


def leaf_keys(levels: EdgeLevels) -> LeafKeys:
    res = dp.below(levels, _LeafKeys())
    return LeafKeys(res.nodes, res.edges, res.clades)


def leaf_closure(levels: EdgeLevels) -> dp.Below:
    return dp.below(levels, _Closure())


def leaf_keys_exact(levels: EdgeLevels) -> LeafKeys:
    """Keys from the (node, leaf) closure; valid for inconsistent DAGs too."""
    res = leaf_closure(levels)
    keys = list(levels.keys)
    member = F.col("leaf")
    clades = res.clades.groupBy(*keys, "parent_id", "clade_index").agg(
        set_key(member).alias("key")
    )
    splits = clades.groupBy(*keys, F.col("parent_id").alias("node_id")).agg(
        set_key(F.col("key")).alias("split")
    )
    nodes = (
        res.nodes.groupBy(*keys, "node_id")
        .agg(set_key(member).alias("key"))
        .join(splits, [*keys, "node_id"])
    )
    below = nodes.select(*keys, F.col("node_id").alias("child_id"), F.col("key").alias("inner_key"))
    edges = levels.ranked.join(below, [*keys, "child_id"], "left").withColumn(
        "key", F.coalesce("inner_key", singleton_key(F.col("leaf_name")))
    ).drop("inner_key")
    return LeafKeys(nodes, edges, clades)


def levels_with_leaves(dag: HistoryDag) -> EdgeLevels:
    return rank_edges(dag, with_leaf_names(dag))
