"""Whole jobs on the merged grouping DAGs: merge, materialise, rank, trim."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import dp, leafsets, merge, trim
from cladeloom.operators import semiring as sr
from cladeloom.plans import tables
from cladeloom.plans.registry import GROUPS, query

# Edges of the merge of a region's trees, with the clade numbers of each parent's first source.
MERGED = f"""{GROUPS},
n1 as (select rk, nk, split, min(t) t from nv group by 1, 2, 3),
gw as (select cl.rk, cl.key, g.k, min(g.k % 7 + ascii(g.t) - 65) w from g join cl on cl.rk = g.rk and cl.nk = g.nk and cl.t = g.t and cl.grp = g.grp group by 1, 2, 3),
me as (
  select rk, 'g' || key parent, 'c' || k child, cast(k as varchar) clade_index, 1 leaves, w from gw
  union all select n1.rk, 'n' || n1.split, 'g' || cl.key, cl.grp, cl.sz, 1 from n1 join cl on cl.rk = n1.rk and cl.nk = n1.nk and cl.t = n1.t
  union all select distinct rk, 'r', 'n' || split, cast(nk as varchar), sz, 2 from nv
  union all select distinct rk, 'u', 'r', '0', sz, 3 from rv)"""


def _merged(spark, sf):
    dag, levels = tables.grouping_trees(spark, sf)
    return merge.merge(dag, tables.region_of().cast("string"), levels)


def _with_leaves(dag, levels):
    """The DAG with the leaf count of every edge's child on the edge."""
    edges = leafsets.leaf_keys(levels).edges
    return dag.with_edges(edges.select(*dag.edges.columns, F.col("key.n").alias("leaves")))


def _shape(edges):
    return edges.groupBy(
        F.col("dag_id").cast("int").alias("rk"), F.col("clade_index").cast("string").alias("clade_index"), "leaves",
        F.col("edge_weight").cast("int").alias("weight"),
    ).agg(F.count(F.lit(1)).alias("edges"), F.sum(F.size("mutations")).cast("bigint").alias("mutations"))


@query(
    "merged_dag_edges",
    f"""with {MERGED}
select rk, clade_index, leaves, cast(w as int) weight, count(*) edges, cast(0 as bigint) mutations from me group by 1, 2, 3, 4""",
)
def merged_dag_edges(spark, sf):
    """The materialised merge of a region's trees, leaf sets found again from its ranked edges."""
    dag = _merged(spark, sf)
    return _shape(_with_leaves(dag, leafsets.levels_with_leaves(dag)).edges)


@query(
    "trimmed_optimum_edges",
    f"""with {MERGED},
gc as (select rk, key, sum(w) w from gw group by 1, 2),
nc as (select n1.rk, n1.nk, n1.split, sum(1 + gc.w) w from n1 join cl on cl.rk = n1.rk and cl.nk = n1.nk and cl.t = n1.t
       join gc on gc.rk = cl.rk and gc.key = cl.key group by 1, 2, 3),
best as (select rk, split from nc qualify w = min(w) over (partition by rk, nk)),
kept as (
  select me.* from me join best on best.rk = me.rk and (me.child = 'n' || best.split or me.parent = 'n' || best.split)
  union all select * from me where parent = 'u'),
leaf as (select distinct me.* from me join kept on kept.rk = me.rk and kept.child = me.parent where me.parent like 'g%')
select rk, clade_index, leaves, cast(w as int) weight, count(*) edges, cast(0 as bigint) mutations
from (select * from kept union all select * from leaf) group by 1, 2, 3, 4""",
)
def trimmed_optimum_edges(spark, sf):
    """All trees of least edge weight in the merge, nodes shared."""
    dag = _merged(spark, sf)
    levels = leafsets.levels_with_leaves(dag)
    best = dp.below(levels, sr.BestWeight(sr.stored_weight(), dtype="double", tolerant=True))
    return _shape(trim.trim_to_best(_with_leaves(dag, levels), best).edges)
