"""Picking k trees that are far apart, and top-k helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.setkeys import set_key
from cladeloom.runtime import cut


def topology_keys(clades: DataFrame, by: list[str]) -> DataFrame:
    """(by..., topology): one key per tree for its set of clades."""
    return clades.select(*by, "key").distinct().groupBy(*by).agg(set_key(F.col("key")).alias("topology"))


def distinct_topologies(keys: DataFrame, group: str, tree: str) -> DataFrame:
    """First tree of every topology, with the number of trees that share it."""
    return keys.groupBy(group, "topology").agg(
        F.min(tree).alias(tree), F.count(F.lit(1)).alias("copies")
    )


def top_k(df: DataFrame, score: str, k: int, tiebreak: list[str]) -> DataFrame:
    return df.orderBy(F.col(score), *tiebreak).limit(k)


def top_k_with_ties(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows and all rows that tie with the k-th."""
    cutoff = df.select(score).orderBy(score).limit(k).agg(F.max(score).alias("cutoff"))
    return df.join(cutoff, F.col(score) <= F.col("cutoff")).drop("cutoff")


def keep_count(k: int) -> int:
    """How many trees of the pool stay before distances are computed."""
    return max(2 * k, 20)


def farthest_first(clades: DataFrame, k: int, group: str = "g", trees: DataFrame | None = None) -> DataFrame:
    """(group, rank, tree, gap): greedy farthest-point order of trees given as (group, dag_id, key) clades.

    First the tree with the largest total distance; then, k-1 times, the one
    farthest from all chosen so far, ties by total distance to them.  Totals come
    from how many trees share each clade.  A pick then costs one join of all
    clades with the newest pick's own, and the least and total distance so far
    are kept per tree; no table of pairs is made.  ``trees`` (group, dag_id)
    names the trees, also such without a clade.
    """
    every = (clades if trees is None else trees).select(group, F.col("dag_id").alias("a")).distinct()
    copies = clades.groupBy(group, "key", F.col("dag_id").alias("a")).agg(F.count(F.lit(1)).alias("copies"))
    # the how manieth copy of a clade is a clade of its own
    unit = copies.join(every, [group, "a"], "left_semi").select(group, "a", "key", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    unit = cut(unit, "clade-units")
    by = [group, "key", "copy"]
    owners = unit.groupBy(*by).agg(F.count(F.lit(1)).alias("owners"))
    held = unit.join(owners, by).groupBy(group, "a").agg(F.count(F.lit(1)).alias("size"), F.sum("owners").alias("shared"))
    sizes = cut(every.join(held, [group, "a"], "left").na.fill(0), "tree-sizes")
    whole = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("trees"), F.sum("size").alias("all"))
    total = F.col("trees") * F.col("size") + F.col("all") - 2 * F.col("shared")
    state = sizes.join(whole, group).select(group, "a", "size", total.alias("gap"), F.lit(0).cast("bigint").alias("far"))
    chosen = None
    for rank in range(1, k + 1):
        state = cut(state, "distances")
        pick = cut(_argbest(state, group).withColumn("rank", F.lit(rank)), "pick")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        if rank == k:
            break
        newest = pick.select(group, F.col("a").alias("pick"))
        own = unit.join(newest, (unit[group] == newest[group]) & (unit["a"] == newest["pick"]), "left_semi").select(*by)
        common = unit.join(own, by).groupBy(group, "a").agg(F.count(F.lit(1)).alias("common"))
        rest = state.join(newest, group).where(F.col("a") != F.col("pick"))
        rest = rest.join(sizes.select(group, F.col("a").alias("pick"), F.col("size").alias("pick_size")), [group, "pick"])
        rf = F.col("size") + F.col("pick_size") - 2 * F.coalesce("common", F.lit(0))
        gap = rf if rank == 1 else F.least("gap", rf)
        state = rest.join(common, [group, "a"], "left").select(group, "a", "size", gap.alias("gap"), (F.col("far") + rf).alias("far"))
    return chosen.select(group, "rank", F.col("a").alias("tree"), "gap")


def _argbest(df: DataFrame, group: str) -> DataFrame:
    """Per group the row with the largest (gap, far); the first tree on a tie."""
    key = F.struct(-F.col("gap"), -F.col("far"), F.col("a"))
    return df.groupBy(group).agg(F.min_by(F.struct("a", "gap", "far"), key).alias("r")).select(group, "r.*")
