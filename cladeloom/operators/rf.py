"""Robinson-Foulds distances and clade multiplicities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT
from cladeloom.functions.setkeys import set_key
from cladeloom.operators import dp
from cladeloom.operators.semiring import BestWeight
from cladeloom.runtime import cut
from cladeloom.schema import HistoryDag


def tree_clades(dag: HistoryDag, keys_nodes: DataFrame) -> DataFrame:
    """(dag_id, key): leaf sets of inner nodes below the root."""
    uas = dag.nodes.where(F.col("kind") == "ua").select("dag_id", F.col("node_id").alias("parent_id"))
    roots = dag.edges.join(uas, ["dag_id", "parent_id"]).select(
        "dag_id", F.col("child_id").alias("node_id")
    )
    return keys_nodes.join(uas.withColumnRenamed("parent_id", "node_id"), ["dag_id", "node_id"], "left_anti").join(
        roots, ["dag_id", "node_id"], "left_anti"
    ).select("dag_id", "key")


def pairwise_rf(clades: DataFrame, group: str = "g", tree: str = "dag_id") -> DataFrame:
    """(group, t1, t2, rf) for every pair of trees of a group.

    Clades with the same set of owning trees count alike: the set's key stands
    for all of them, with how many there are, and one clade of each kind keeps
    its owners.  Pairs come from an equal join on the kind, never from gathered
    lists, and are counted before they are shuffled.
    """
    once = clades.groupBy(group, "key", tree).agg(F.count(F.lit(1)).alias("copies"))
    kind_of = once.groupBy(group, "key").agg(set_key(F.struct(F.col(tree).alias("t"), "copies")).alias("kind"))
    kinds = kind_of.groupBy(group, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    held = cut(kinds.join(once, [group, "key"]).select(group, "key", "n", F.col(tree).alias("t"), "copies"), "kinds")
    other = held.select(group, "key", F.col("t").alias("t2"), F.col("copies").alias("c2"))
    shared = (
        held.withColumnsRenamed({"t": "t1", "copies": "c1"}).join(other, [group, "key"])
        .where(F.col("t1") < F.col("t2"))
        .groupBy(group, "t1", "t2").agg(F.sum(F.least("c1", "c2") * F.col("n")).alias("shared"))
    )
    per_tree = held.groupBy(group, "t").agg(F.sum(F.col("copies") * F.col("n")).alias("size"))
    t1 = per_tree.withColumnsRenamed({"t": "t1", "size": "s1"})
    t2 = per_tree.withColumnsRenamed({"t": "t2", "size": "s2"})
    return (
        t1.join(t2, group).where(F.col("t1") < F.col("t2"))
        .join(shared, [group, "t1", "t2"], "left")
        .select(
            group, "t1", "t2",
            (F.col("s1") + F.col("s2") - 2 * F.coalesce("shared", F.lit(0))).alias("rf"),
        )
    )


def clade_multiplicity(node_keys: DataFrame, above: DataFrame, below: DataFrame, by: list[str]) -> DataFrame:
    """(by..., key, trees): number of trees that contain each leaf set.

    ``node_keys``: dag_id, node_id, key for leaves and inner nodes alike.
    """
    ids = ["dag_id", "node_id"]
    joined = node_keys.join(above, ids).join(below.select(*ids, "n"), ids, "left")
    trees = F.try_multiply("above_n", F.coalesce("n", F.lit(1).cast(COUNT))).cast(COUNT)
    return joined.groupBy(*by, "key").agg(F.try_sum(trees).cast(COUNT).alias("trees"))


def _counted(value: Column) -> Column:
    """A tree count, or an error where it does not fit: a missing one would choose wrongly."""
    lost = F.raise_error(F.lit("a tree count has over 38 digits: distances cannot be summed exactly"))
    return F.coalesce(value, lost.cast(COUNT))


def rf_weights(edges: DataFrame, multiplicity: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rf_w`` = N - 2 * (reference trees with the child's leaf set).

    ``edges`` carries ``key`` of each child; ``totals`` has (by..., num_trees).
    Leaf sets that no reference tree has count zero.
    """
    known = multiplicity.withColumn("trees", _counted(F.col("trees")))
    return (
        edges.join(known, [*by, "key"], "left")
        .join(totals.withColumn("num_trees", _counted(F.col("num_trees"))), by)
        .withColumn(
            "rf_w",
            (F.col("num_trees") - 2 * F.coalesce("trees", F.lit(0).cast(COUNT))).cast(COUNT),
        )
        .drop("trees")
    )


def rf_shift(multiplicity: DataFrame, by: list[str]) -> DataFrame:
    """(by..., shift): constant that turns the edge-weight sum into a distance sum."""
    return multiplicity.groupBy(*by).agg(F.sum(_counted(F.col("trees"))).cast(COUNT).alias("shift"))


def best_sum_rf(largest: bool = False) -> BestWeight:
    """Minimum (or maximum) sum of RF distances to the reference trees."""
    return BestWeight(F.col("rf_w"), largest=largest, dtype=COUNT)
