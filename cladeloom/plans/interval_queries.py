"""Subtree intervals of trees over the business tables, and ancestor tests on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import intervals
from cladeloom.plans import tables
from cladeloom.plans.registry import GROUPS, query
from cladeloom.runtime import cut


def heap_intervals(spark, sf):
    """(nodes, spans) of the customer heap tree."""
    nodes = tables.heap_tree(spark, sf)[0].select(F.lit("heap").alias("dag_id"), "node_id", "parent_id")
    nodes = cut(nodes, "heap")
    return nodes, cut(intervals.euler_intervals(nodes, ["dag_id"]), "spans")


@query(
    "subtree_intervals",
    """with mx as (select max(c_custkey) + 1 n from customer), h as (select c_custkey + 1 i, n from customer, mx)
select i node_id, cast(sum(greatest(0, least(n, (i + 1) * cast(2 ** d as bigint) - 1) - i * cast(2 ** d as bigint) + 1)) as bigint) below,
       true nested, cast(n as bigint) numbers
from h, range(1, 40) r(d) group by i, n""",
)
def subtree_intervals(spark, sf):
    """Nodes below every heap node by its interval, whether the parent's interval holds it, and how many numbers are used."""
    nodes, spans = heap_intervals(spark, sf)
    both = intervals.with_intervals(nodes, spans, ["dag_id"], "node_id")
    up = spans.select("dag_id", F.col("node_id").alias("parent_id"), F.col("enter").alias("p_enter"), F.col("leave").alias("p_leave"))
    inside = (F.col("p_enter") < F.col("node_id_enter")) & (F.col("node_id_leave") <= F.col("p_leave"))
    numbers = spans.groupBy("dag_id").agg(F.count_distinct("enter").alias("numbers"))
    return both.join(up, ["dag_id", "parent_id"], "left").join(numbers, "dag_id").select(
        "node_id", (F.col("node_id_leave") - F.col("node_id_enter") - 1).alias("below"),
        F.coalesce(inside, F.col("parent_id").isNull()).alias("nested"), "numbers",
    )


@query(
    "ancestor_tests",
    """with mx as (select max(c_custkey) + 1 n from customer),
p as (select o_orderkey, o_custkey + 1 a, o_orderkey % n + 1 b from orders, mx),
d as (select *, cast(floor(log2(a)) as int) da, cast(floor(log2(b)) as int) db from p)
select o_orderkey, case when a = b then 'same' when db > da and b // cast(2 ** greatest(db - da, 0) as bigint) = a then 'above'
  when da > db and a // cast(2 ** greatest(da - db, 0) as bigint) = b then 'below' else 'apart' end relation from d""",
)
def ancestor_tests(spark, sf):
    """How two heap nodes of every order lie to each other: two joins by node, whatever the depth."""
    nodes, spans = heap_intervals(spark, sf)
    n = nodes.agg(F.max("node_id").alias("n"))
    last = n.first()[0] or 1
    pairs = tables.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("heap").alias("dag_id"), (F.col("o_custkey") + 1).alias("a"), (F.col("o_orderkey") % last + 1).alias("b")
    )
    placed = intervals.with_intervals(pairs, spans, ["dag_id"], "a", "b")
    relation = F.when(F.col("a") == F.col("b"), "same").when(intervals.is_above("a", "b"), "above").when(intervals.is_above("b", "a"), "below").otherwise("apart")
    return placed.select("o_orderkey", relation.alias("relation"))


@query(
    "clade_members_by_interval",
    f"with {GROUPS} select rk, nk, t, count(*) + count(distinct grp) below, count(*) leaves from g group by rk, nk, t",
)
def clade_members_by_interval(spark, sf):
    """Nodes and customers below every nation of every grouping tree, by ranges of interval numbers."""
    dag, _ = tables.grouping_trees(spark, sf)
    rows = dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.when(F.col("parent_id") != "ua", F.col("parent_id")).alias("parent_id"))
    spans = cut(intervals.euler_intervals(cut(rows, "trees"), ["dag_id"]), "spans")
    nation = spans.where(F.col("node_id").rlike("^n[0-9]+$"))
    leaf = spans.where(F.col("node_id").startswith("c")).groupBy("dag_id", "enter").agg(F.count(F.lit(1)).alias("n"))
    # leaves before each number, by one running count per tree, give the leaves of every range
    starts = nation.select("dag_id", F.col("node_id").alias("nation"), F.explode(F.array(F.struct("enter", F.lit(-1).alias("sign")), F.struct(F.col("leave").alias("enter"), F.lit(1).alias("sign")))).alias("e"))
    marks = starts.select("dag_id", "nation", "e.enter", "e.sign", F.lit(0).cast("bigint").alias("n"))
    steps = marks.unionByName(leaf.select("dag_id", F.lit(None).cast("string").alias("nation"), "enter", F.lit(None).cast("int").alias("sign"), "n"))
    counted = intervals.running_total(steps, ["dag_id"], "enter", "n").where("nation is not null")
    leaves = counted.groupBy("dag_id", "nation").agg(F.sum(F.col("sign") * F.col("before")).alias("leaves"))
    return nation.join(leaves.withColumnRenamed("nation", "node_id"), ["dag_id", "node_id"]).select(
        tables.region_of().cast("bigint").alias("rk"), F.expr("cast(substr(node_id, 2) as bigint)").alias("nk"),
        F.substring_index("dag_id", "/", -1).alias("t"), (F.col("leave") - F.col("enter") - 1).alias("below"), "leaves",
    )
