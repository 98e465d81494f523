"""Subtree intervals: numbers of an Euler tour of every tree.

Trees of up to ``LEVELS`` levels are numbered level by level: sizes upwards,
numbers downwards, each node once a pass.  The tour of deeper ones, in which
each node is entered once and left once, is a linked list; doubling its pointers
adds up what lies behind each step in as many rounds as the tour's length has
binary digits, whatever the tree's depth, but moves every step in each.  With
[enter, leave) of each node, "a is above b" is a comparison of numbers, and the
part below a node a range, where a table of all (node, ancestor) pairs would
grow with nodes times depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.runtime import cut

#: Parts that the children of one node are numbered in, so that no task orders a whole large family.
PARTS = 64
#: Levels up to which trees are numbered level by level.
LEVELS = 40


def list_ranks(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, total): the sum of ``weight`` from each item to its list's end, the item included.

    ``links`` is (keys, item, next, weight); ``next`` is null at an end.  A round
    joins the items that have not reached their end with all items.
    """
    state = cut(links.select(*keys, "item", "next", F.col("weight").alias("total")), "list")
    while not state.where(F.col("next").isNotNull()).isEmpty():
        behind = state.select(*keys, F.col("item").alias("next"), F.col("next").alias("after"), F.col("total").alias("more"))
        open_ = state.where(F.col("next").isNotNull()).join(behind, [*keys, "next"]).select(
            *keys, "item", F.col("after").alias("next"), (F.col("total") + F.col("more")).alias("total")
        )
        state = cut(state.where(F.col("next").isNull()).unionByName(open_), "list")
    return state.select(*keys, "item", "total")


def euler_intervals(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, enter, leave) of trees given as (keys, node_id, parent_id), null at the root.

    ``enter`` numbers a tree's nodes from 0 so that everything below a node
    follows it; ``leave`` is one more than the last number below it.  Children
    stand in the order of a hash; each set of ``keys`` is one tree.
    """
    if not keys:
        return euler_intervals(nodes.withColumn("tree", F.lit(0)), ["tree"]).drop("tree")
    body = nodes.select(*keys, "node_id", "parent_id")
    levels = _levels(body, keys)
    return _by_tour(body, keys) if levels is None else _by_level(levels, keys)


def _levels(body: DataFrame, keys: list[str]) -> list[DataFrame] | None:
    """(keys, node_id, parent_id) per level from the roots down, or None if there are more than ``LEVELS``."""
    inner = cut(body.where(F.col("parent_id").isNotNull()), "below")
    levels = [cut(body.where(F.col("parent_id").isNull()), "level")]
    placed = 0
    while not levels[-1].isEmpty():
        if len(levels) > LEVELS:
            return None
        above = levels[-1].select(*keys, F.col("node_id").alias("parent_id"))
        levels.append(cut(inner.join(above, [*keys, "parent_id"]).select(*keys, "node_id", "parent_id"), "level"))
        placed += levels[-1].count()
    if placed != inner.count():
        raise ValueError("some nodes hang below no root")
    return levels[:-1] or levels


def _by_level(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Intervals of trees given by their levels: sizes from the last level up, numbers from the first down."""
    family = [*keys, "parent_id"]
    one = F.lit(1).cast("bigint")
    sized = [cut(levels[-1].withColumn("size", one), "sizes")]
    for level in reversed(levels[:-1]):
        below = sized[0].groupBy(*family).agg(F.sum("size").alias("below")).withColumnRenamed("parent_id", "node_id")
        size = one + F.coalesce("below", F.lit(0))
        sized.insert(0, cut(level.join(below, [*keys, "node_id"], "left").select(*keys, "node_id", "parent_id", size.alias("size")), "sizes"))
    # What stands before a node among its siblings: the parts before its own, and the nodes before it in its part.
    part = F.pmod(F.xxhash64("node_id"), F.lit(PARTS)).alias("part")
    kids = [s.select("*", part, F.lit(d).alias("depth")) for d, s in enumerate(sized) if d]
    enter = F.lit(0).cast("bigint").alias("enter")
    numbered = [sized[0].select(*keys, "node_id", enter, "size")]
    if kids:
        kids = reduce(DataFrame.unionByName, kids)
        ahead = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = kids.groupBy(*family, "part").agg(F.sum("size").alias("size"))
        parts = parts.select(*family, "part", ahead(Window.partitionBy(*family).orderBy("part")).alias("parts"))
        inside = ahead(Window.partitionBy(*family, "part").orderBy("node_id")).alias("inside")
        placed = kids.select(*family, "node_id", "size", "part", "depth", inside).join(parts, [*family, "part"])
        placed = cut(placed.select(*family, "node_id", "size", "depth", (F.col("parts") + F.col("inside") + 1).alias("offset")), "placed", ("depth",))
    for d in range(1, len(sized)):
        above = numbered[-1].select(*keys, F.col("node_id").alias("parent_id"), "enter")
        here = placed.where(F.col("depth") == d).join(above, family)
        numbered.append(cut(here.select(*keys, "node_id", (F.col("enter") + F.col("offset")).alias("enter"), "size"), "numbers"))
    return reduce(DataFrame.unionByName, numbered).select(*keys, "node_id", "enter", (F.col("enter") + F.col("size")).alias("leave"))


def _by_tour(body: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of trees of any depth, by the ranks of their tours."""
    part = F.pmod(F.xxhash64("node_id"), F.lit(PARTS)).alias("part")
    kids = body.where(F.col("parent_id").isNotNull()).select(*keys, "parent_id", part, "node_id")
    family = [*keys, "parent_id"]
    after = F.lead("node_id").over(Window.partitionBy(*family, "part").orderBy("node_id"))
    kids = cut(kids.withColumn("after", after), "siblings")
    heads = kids.groupBy(*family, "part").agg(F.min("node_id").alias("head"))
    first = heads.groupBy(*family).agg(F.min(F.struct("part", "head")).alias("first"))
    # the last of a part is followed by the first of the next part
    heads = heads.withColumn("follower", F.lead("head").over(Window.partitionBy(*family).orderBy("part"))).drop("head")
    step = lambda c, side: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("node_id"), F.lit(side).alias("side")))
    ups = kids.join(heads, [*family, "part"]).withColumn("sibling", F.coalesce("after", "follower"))
    ups = ups.select(*keys, "node_id", F.coalesce(step("sibling", 0), step("parent_id", 1)).alias("next"))
    roots = body.where(F.col("parent_id").isNull()).select(*keys, "node_id", F.lit(None).cast(ups.schema["next"].dataType).alias("next"))
    own = lambda side: F.struct(F.col("node_id"), F.lit(side).alias("side")).alias("item")
    left = ups.unionByName(roots).select(*keys, own(1), "next", F.lit(0).cast("bigint").alias("weight"))
    child = first.select(*keys, F.col("parent_id").alias("node_id"), F.col("first.head").alias("child"))
    entered = body.join(child, [*keys, "node_id"], "left").select(
        *keys, own(0), F.coalesce(step("child", 0), step("node_id", 1)).alias("next"), F.lit(1).cast("bigint").alias("weight")
    )
    ranks = cut(list_ranks(entered.unionByName(left), keys), "tour")
    by_node = ranks.groupBy(*keys, F.col("item.node_id").alias("node_id")).agg(
        F.max(F.when(F.col("item.side") == 0, F.col("total"))).alias("down"), F.max(F.when(F.col("item.side") == 1, F.col("total"))).alias("up")
    )
    size = ranks.groupBy(*keys).agg(F.max("total").alias("size"))
    return by_node.join(size, keys).select(
        *keys, "node_id", (F.col("size") - F.col("down")).alias("enter"), (F.col("size") - F.col("up")).alias("leave")
    )


def with_intervals(pairs: DataFrame, spans: DataFrame, keys: list[str], *ends: str) -> DataFrame:
    """``pairs`` with ``<end>_enter`` and ``<end>_leave`` of the nodes in the columns ``ends``."""
    for end in ends:
        pairs = pairs.join(spans.select(*keys, F.col("node_id").alias(end), F.col("enter").alias(f"{end}_enter"), F.col("leave").alias(f"{end}_leave")), [*keys, end])
    return pairs


def is_above(a: str, b: str):
    """Whether the node in column ``a`` is a proper ancestor of that in ``b``; both with their intervals."""
    return (F.col(f"{a}_enter") < F.col(f"{b}_enter")) & (F.col(f"{b}_enter") < F.col(f"{a}_leave"))


def strictly_below(spans: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id) of the nodes below the given ones (keys, node_id), one per tree: a range of numbers each."""
    top = with_intervals(roots.select(*keys, F.col("node_id").alias("top")), spans, keys, "top")
    return spans.join(top, keys).where((F.col("top_enter") < F.col("enter")) & (F.col("enter") < F.col("top_leave"))).select(*keys, "node_id")


def running_total(rows: DataFrame, keys: list[str], place: str, value: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` at lesser places of the same keys.

    Places are dealt to runs of ``width`` numbers: sums of whole runs are added up
    first, then places within each run, so no task orders a whole tree.
    """
    run = F.floor(F.col(place) / width).alias("run")
    sums = rows.groupBy(*keys, run).agg(F.sum(value).alias("in_run"))
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "run", F.coalesce(F.sum("in_run").over(ahead), F.lit(0)).alias("runs"))
    inside = Window.partitionBy(*keys, "run").orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    part = rows.select("*", run).withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(sums, [*keys, "run"]).withColumn("before", F.col("runs") + F.col("inside")).drop("run", "runs", "inside")
