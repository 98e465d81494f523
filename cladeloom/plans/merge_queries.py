"""Merging, clade and distance queries over the grouping trees."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT
from cladeloom.functions.setkeys import set_key
from cladeloom.operators import diverse, dp, leafsets, merge, rf, trim, validate
from cladeloom.operators import semiring as sr
from cladeloom.operators.levels import Level, layered
from cladeloom.plans import tables
from cladeloom.plans.registry import GROUPS, query
from cladeloom.runtime import cut, spread
from cladeloom.schema import GENOME, HistoryDag


def _labelled(spark, sf, trees="ABCD", fragments=""):
    dag, levels = tables.grouping_trees(spark, sf, trees, fragments)
    return merge.label(dag, leafsets.leaf_keys(levels), tables.region_of())


@query(
    "leaf_sets",
    f"""with {GROUPS}, same as (select rk, key, count(*) n from cl group by rk, key)
select nk, t, grp, sz leaves, n twins from cl join same on same.rk = cl.rk and same.key = cl.key""",
)
def leaf_sets(spark, sf):
    """Leaves of every group, and how many groups of the region hold exactly these leaves."""
    g = tables.customer_groups(spark, sf)
    sets = g.groupBy("rk", "nk", "t", "grp").agg(set_key(F.col("k")).alias("key"))
    twins = sets.groupBy("rk", "key").agg(F.count(F.lit(1)).alias("twins"))
    return sets.join(twins, ["rk", "key"]).select(
        "nk", "t", "grp", F.col("key.n").alias("leaves"), "twins"
    )


@query(
    "merged_nodes",
    f"""with {GROUPS}
select rk, 'leaf' kind, 1 leaves, count(distinct k) nodes from g group by 1
union all
select rk, 'inner', leaves, count(*) from (
  select distinct rk, key id, sz leaves from cl
  union all select distinct rk, split, sz from nv
  union all select distinct rk, split || md5(string_agg(x, ',' order by x)) id, sz from (
    select rv.rk, rv.t, rv.split, rv.sz, n.x from rv join (select rk, t, md5(string_agg(cast(k as varchar), ',' order by k)) x from g group by rk, nk, t) n on n.rk = rv.rk and n.t = rv.t
  ) group by rk, t, split, sz
) group by 1, 3""",
)
def merged_nodes(spark, sf):
    """Distinct nodes of the merge of all trees of a region, by kind and leaf count."""
    nodes = merge.dedup_nodes(_labelled(spark, sf).nodes)
    return nodes.groupBy(F.col("g").alias("rk"), "kind", F.col("key.n").alias("leaves")).agg(
        F.count(F.lit(1)).alias("nodes")
    )


@query(
    "merged_edges",
    f"""with {GROUPS},
e as (
  select cl.rk, 'g' || cl.key parent, 'c' || g.k child, 1 leaves, g.k % 7 + ascii(g.t) - 65 w
    from g join cl on cl.rk = g.rk and cl.nk = g.nk and cl.t = g.t and cl.grp = g.grp
  union all select cl.rk, 'n' || nv.split, 'g' || cl.key, cl.sz, 1 from cl join nv on nv.rk = cl.rk and nv.nk = cl.nk and nv.t = cl.t
  union all select nv.rk, 'r', 'n' || nv.split, nv.sz, 2 from nv),
m as (select rk, parent, child, leaves, min(w) w from e group by 1, 2, 3, 4)
select rk, cast(leaves as bigint) leaves, count(*) edges, cast(sum(w) as bigint) weight from m group by 1, 2""",
)
def merged_edges(spark, sf):
    """Distinct edges of the merge with their least weight, by leaf count of the child."""
    edges = merge.dedup_edges(_labelled(spark, sf).edges)
    return edges.groupBy(F.col("g").alias("rk"), F.col("key.n").alias("leaves")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("edge_weight").cast("bigint").alias("weight")
    )


@query(
    "merge_counters",
    f"""with {GROUPS},
n as (select rk, count(distinct k) n from g group by rk union all select rk, count(distinct key) from cl group by rk
      union all select rk, count(distinct split) from nv group by rk union all select rk, 1 from rv group by rk),
e as (select rk, count(distinct key || '/' || k) n from (select cl.rk, cl.key, g.k from g join cl on cl.rk = g.rk and cl.nk = g.nk and cl.t = g.t and cl.grp = g.grp) group by rk
      union all select cl.rk, count(distinct nv.split || cl.key) from cl join nv on nv.rk = cl.rk and nv.nk = cl.nk and nv.t = cl.t group by cl.rk
      union all select rk, count(distinct split) from nv group by rk union all select rk, 1 from rv group by rk)
select a.rk, cast(a.n + 1 as bigint) nodes, cast(b.n as bigint) edges from (select rk, sum(n) n from n group by rk) a join (select rk, sum(n) n from e group by rk) b on a.rk = b.rk""",
)
def merge_counters(spark, sf):
    return merge.counters(_labelled(spark, sf)).select(F.col("g").alias("rk"), "nodes", "edges")


@query(
    "merged_clade_index",
    f"""with {GROUPS},
n1 as (select rk, nk, split, min(t) t from nv group by 1, 2, 3),
g1 as (select rk, key, min(t || '/' || nk || '/' || grp) src from cl group by 1, 2),
r1 as (select rk, split, min(t) t from rv group by 1, 2)
select f.rk, f.t, 'nation' parent, cl.grp clade_index, cl.sz leaves from n1 f join cl on cl.rk = f.rk and cl.nk = f.nk and cl.t = f.t
union all select f.rk, f.t, 'region', cast(nv.nk as varchar), nv.sz from r1 f join (select rk, nk, t, max(sz) sz from nv group by all) nv on nv.rk = f.rk and nv.t = f.t
union all select f.rk, split_part(f.src, '/', 1), 'group', cast(g.k as varchar), 1 from g1 f join g on g.rk = f.rk and g.t || '/' || g.nk || '/' || g.grp = f.src""",
)
def merged_clade_index(spark, sf):
    """Clade number of every merged edge below a region, as its parent's first source node numbers it."""
    rows = _labelled(spark, sf)
    inner = rows.edges
    first = inner.groupBy("g", "parent").agg(F.min(F.struct("dag_id", "parent_id")).alias("src"))
    slots = merge.clade_slots(inner)
    per_clade = slots.join(first, ["g", "parent"])
    parent = F.col("src.parent_id")
    kind = F.when(parent.contains("/"), "group").when(parent.startswith("n"), "nation").otherwise("region")
    return per_clade.select(
        F.col("g").alias("rk"), F.substring_index("src.dag_id", "/", -1).alias("t"), kind.alias("parent"),
        F.col("clade_index").cast("string").alias("clade_index"), F.col("key.n").alias("leaves"),
    )


@query(
    "orphan_attachment",
    f"""with {GROUPS},
home as (select distinct cl.rk, nv.split, cl.key from cl join nv on nv.rk = cl.rk and nv.nk = cl.nk and nv.t = cl.t where cl.t in ('A', 'B')
  union select distinct cl.rk, cl.key, md5(cast(g.k as varchar)) from g join cl on cl.rk = g.rk and cl.nk = g.nk and cl.t = g.t and cl.grp = g.grp where g.t in ('A', 'B')),
loose as (select distinct rk, key, sz from cl where t in ('C', 'D')),
hit as (select loose.rk, loose.sz, home.split from loose left join home on home.rk = loose.rk and home.key = loose.key)
select rk, sz leaves, count(split) adopted, count(*) filter (where split is null) under_root from hit group by 1, 2
union all select rk, cast(count(distinct k) as bigint), 0, 1 from g group by rk""",
)
def orphan_attachment(spark, sf):
    """Trees C and D cut down to group fragments and hung into the merge of A and B."""
    rows = _labelled(spark, sf, fragments="CD")
    rows = replace(rows, edges=cut(rows.edges, "arcs"))
    nodes, edges = merge.dedup_nodes(rows.nodes), merge.dedup_edges(rows.edges)
    arcs = merge.orphan_edges(
        nodes, edges, merge.clade_slots(rows.edges), merge.dedup_root_edges(rows.root_edges)
    )
    sizes = nodes.select("g", F.col("label").alias("child"), F.col("key.n").alias("leaves"))
    under_root = F.col("parent") == merge.UA_LABEL
    return arcs.join(sizes, ["g", "child"]).groupBy(F.col("g").alias("rk"), "leaves").agg(
        F.count_if(~under_root).alias("adopted"), F.count_if(under_root).alias("under_root")
    )


@query(
    "clade_coverage",
    """with v as (
  select c_nationkey nk, 'A' t, c_custkey k from customer where c_custkey % 13 <> 0
  union all select c_nationkey, 'B', c_custkey from customer where c_custkey % 11 <> 0),
e as (select nk, t, count(*) n from v group by 1, 2),
u as (select nk, count(distinct k) n from v group by 1)
select e.nk, e.t, e.n leaves, u.n clade_leaves, max(e.n) over (partition by e.nk) = u.n complete, e.n < u.n short from e join u on u.nk = e.nk""",
)
def clade_coverage(spark, sf):
    """Two alternatives per nation that each miss some leaves: what trimming decides on."""
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    ways = F.array_compact(F.array(
        F.when(F.col("c_custkey") % 13 != 0, F.lit("A")), F.when(F.col("c_custkey") % 11 != 0, F.lit("B"))
    ))
    leaf = c.select("c_nationkey", "c_custkey", F.explode(ways).alias("t")).select(
        F.concat_ws("/", F.col("c_nationkey").cast("string"), "t").alias("parent_id"),
        F.col("c_custkey").cast("string").alias("child_id"),
        F.col("c_custkey").alias("clade_index"),
        F.col("c_custkey").cast("string").alias("leaf_name"),
    )
    alt = leaf.select("parent_id").distinct().select(
        F.lit("world").alias("parent_id"), F.col("parent_id").alias("child_id"),
        F.substring_index("parent_id", "/", 1).cast("bigint").alias("clade_index"),
        F.lit(None).cast("string").alias("leaf_name"),
    )
    leaf = leafsets.with_leaf_bits(leaf, [])
    res = leafsets.leaf_bits(layered(Level(leaf, "leaf"), Level(alt, "inner")))
    cover = trim.clade_coverage(res.edge_parts[1], res.clade_parts[1], [])
    return cover.select(
        F.col("clade_index").cast("int").alias("nk"), F.substring_index("child_id", "/", -1).alias("t"),
        "leaves", "clade_leaves", "complete", "short",
    )


def _gappy_dags(spark, sf) -> HistoryDag:
    """A DAG per region: nation -> version A or B -> segment -> variant x or y -> customer, some customers left out."""
    c = spread(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg")))
    n = tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("string").alias("dag_id"))
    way = lambda t, v: F.struct(F.lit(t).alias("t"), F.lit(v).alias("v"))
    ways = F.array_compact(F.array(
        F.when(F.col("k") % 13 != 0, way("A", "x")), F.when(F.col("k") % 11 != 0, way("A", "y")),
        F.when(F.col("k") % 13 != 0, way("B", "x")), way("B", "y"),
    ))
    rows = c.join(n, "nk").select("dag_id", "nk", "seg", "k", F.inline(ways))
    version = F.concat_ws("/", F.concat(F.lit("n"), F.col("nk").cast("string")), "t")
    rows = cut(rows.select(
        "dag_id", "nk", "seg", version.alias("version"), F.concat_ws("/", version, "seg", "v").alias("variant"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("leaf"), "k",
    ), "gappy")
    arc = lambda parent, child, clade: rows.select("dag_id", F.expr(parent).alias("parent_id"), F.expr(child).alias("child_id"), F.expr(clade).alias("clade_index")).distinct()
    arcs = arc("variant", "leaf", "cast(k as int)").unionByName(arc("version", "variant", "cast(ascii(seg) as int)"))
    arcs = arcs.unionByName(arc("'root'", "version", "cast(nk as int)")).unionByName(arc("'ua'", "'root'", "0"))
    edges = cut(arcs.withColumns({"edge_weight": F.lit(0.0), "edge_id": F.xxhash64("parent_id", "child_id")}), "gappy-edges")
    ids = edges.select("dag_id", F.col("child_id").alias("node_id")).distinct().unionByName(edges.select("dag_id", F.lit("ua").alias("node_id")).distinct())
    kind = F.when(F.col("node_id") == "ua", "ua").when(F.col("node_id").startswith("c"), "leaf").otherwise("inner")
    nodes = ids.select("dag_id", "node_id", kind.alias("kind"), F.when(kind == "leaf", F.col("node_id")).alias("sample_id"), F.array().cast(GENOME).alias("cg"))
    refs = edges.select("dag_id").distinct().select("dag_id", F.lit("ref").alias("reference_id"), tables.reference().alias("reference_seq"))
    return HistoryDag(nodes, edges, refs)


@query(
    "trim_rounds",
    """with c as (select n_regionkey rk, c_nationkey nk, c_mktsegment seg, c_custkey k from customer join nation on n_nationkey = c_nationkey),
v as (select *, 'A' t, 'x' v from c where k % 13 <> 0 union all select *, 'A', 'y' from c where k % 11 <> 0
  union all select *, 'B', 'x' from c where k % 13 <> 0 union all select *, 'B', 'y' from c),
e as (select rk, nk, t, seg, v, count(*) n from v group by all),
u as (select rk, nk, t, seg, count(distinct k) un from v group by all),
g as (select *, max(n) over (partition by rk, nk, t, seg) m, count(*) over (partition by rk, nk, t, seg) alts from e join u using (rk, nk, t, seg)),
a as (select rk, nk, t, count(distinct k) n from v group by all),
b as (select rk, nk, count(distinct k) un from v group by all),
h as (select *, max(n) over (partition by rk, nk) m, count(*) over (partition by rk, nk) alts from a join b using (rk, nk)),
gone as (select rk, count(*) n from (select rk from g where alts > 1 and m = un and n < un union all select rk from h where alts > 1 and m = un and n < un) group by 1),
first as (select rk, count(distinct (nk, t, seg)) n from g where alts > 1 and m < un group by 1),
again as (select rk, count(distinct (nk, t, seg)) n from g join h using (rk, nk, t) where g.alts > 1 and g.m < g.un and not (h.alts > 1 and h.m = h.un and h.n < h.un) group by 1)
select cast(r.rk as varchar) dag_id, coalesce(gone.n, 0) edges_removed,
  coalesce(first.n, 0) + case when (select count(*) from gone) > 0 then coalesce(again.n, 0) else 0 end unresolvable
from (select distinct rk from c) r left join gone using (rk) left join first using (rk) left join again using (rk)""",
)
def trim_rounds(spark, sf):
    """Alternatives that miss leaves, dropped at two levels until nothing changes; clades without a whole alternative by round."""
    dag = _gappy_dags(spark, sf)
    report = trim.trim_inconsistent(dag)[1]
    return dag.refs.select("dag_id").join(report, "dag_id", "left").na.fill(0)


@query(
    "novel_nodes",
    f"""with {GROUPS},
known as (select distinct rk, key id from (select rk, md5(string_agg(cast(k as varchar), ',' order by k)) key from g where t in ('A', 'B') group by rk, nk, t, grp) union select rk, split from nv where t in ('A', 'B')),
frag as (select rk, t, key id from cl where t in ('C', 'D') union all select rk, t, split from nv where t in ('C', 'D')),
rt as (select rk, t, string_agg(split, ',' order by nk) id from nv group by rk, t)
select f.rk, f.t, cast(count(*) as bigint) novel from (
  select rk, t from frag where not exists (select 1 from known where known.id = frag.id and known.rk = frag.rk)
) f group by 1, 2
union all
select distinct rk, t, 0 from frag where not exists (select 1 from frag x where x.rk = frag.rk and x.t = frag.t and not exists (select 1 from known where known.id = x.id and known.rk = x.rk))""",
)
def novel_nodes(spark, sf):
    """Inner nodes of trees C and D whose clade split the merge of A and B lacks."""
    known, known_levels = tables.grouping_trees(spark, sf, "AB")
    frag, frag_levels = tables.grouping_trees(spark, sf, "CD")
    keys = leafsets.leaf_keys(known_levels)
    of_region = replace(keys, nodes=keys.nodes.withColumn("dag_id", tables.region_of()))
    out = merge.novel_nodes(frag, leafsets.leaf_keys(frag_levels), of_region, tables.region_of())
    return out.select(
        tables.region_of().alias("rk"), F.substring_index("dag_id", "/", -1).alias("t"), "novel"
    )


def _clades(spark, sf):
    """(g, tree, key) of inner nodes below the root."""
    dag, levels = tables.grouping_trees(spark, sf)
    keys = leafsets.leaf_keys(levels)
    return rf.tree_clades(dag, keys.nodes).select(
        tables.region_of().alias("g"), F.substring_index("dag_id", "/", -1).alias("dag_id"), "key"
    )


CLADES = f"""{GROUPS},
cs as (select rk, t, key, count(*) n from (
  select rk, t, key from cl
  union all select rk, t, md5(string_agg(cast(k as varchar), ',' order by k)) from g group by rk, t, nk) group by 1, 2, 3),
tot as (select rk, t, sum(n) n from cs group by 1, 2),
sh as (select a.rk, a.t t1, b.t t2, sum(least(a.n, b.n)) n from cs a join cs b on b.rk = a.rk and b.key = a.key and a.t < b.t group by 1, 2, 3),
pr as (select a.rk, a.t t1, b.t t2, cast(a.n + b.n - 2 * coalesce(sh.n, 0) as bigint) rf from tot a join tot b on b.rk = a.rk and a.t < b.t
       left join sh on sh.rk = a.rk and sh.t1 = a.t and sh.t2 = b.t)
"""


@query("pairwise_rf", f"with {CLADES} select rk, t1, t2, rf from pr")
def pairwise_rf(spark, sf):
    return rf.pairwise_rf(_clades(spark, sf)).withColumnRenamed("g", "rk")


@query(
    "distinct_topologies",
    f"""with {CLADES}, topo as (select rk, t, string_agg(distinct key, ',' order by key) s from cs group by 1, 2)
select rk, min(t) t, count(*) copies from topo group by rk, s""",
)
def distinct_topologies(spark, sf):
    keys = diverse.topology_keys(_clades(spark, sf), ["g", "dag_id"])
    return diverse.distinct_topologies(keys, "g", "dag_id").select(
        F.col("g").alias("rk"), F.col("dag_id").alias("t"), "copies"
    )


@query(
    "diverse_trees",
    f"""with {CLADES},
bo as (select rk, t1 a, t2 b, rf from pr union all select rk, t2, t1, rf from pr),
f1 as (select rk, arg_min(a, (-s, a)) a, cast(max(s) as bigint) gap from (select rk, a, sum(rf) s from bo group by 1, 2) group by rk),
d2 as (select bo.rk, bo.a, rf from bo join f1 on f1.rk = bo.rk and f1.a = bo.b),
f2 as (select rk, arg_min(a, (-rf, a)) a, cast(max(rf) as bigint) gap from d2 group by rk),
d3 as (select bo.rk, bo.a, min(rf) m, sum(rf) s from bo join (select rk, a from f1 union all select rk, a from f2) c on c.rk = bo.rk and c.a = bo.b
       where not exists (select 1 from f1 where f1.rk = bo.rk and f1.a = bo.a) and not exists (select 1 from f2 where f2.rk = bo.rk and f2.a = bo.a) group by 1, 2),
f3 as (select rk, arg_min(a, (-m, -s, a)) a, cast(max(m) as bigint) gap from d3 group by rk)
select rk, 1 rank, a tree, gap from f1 union all select rk, 2, a, gap from f2 union all select rk, 3, a, gap from f3""",
)
def diverse_trees(spark, sf):
    """Three trees per region picked farthest-first."""
    return diverse.farthest_first(_clades(spark, sf), 3).withColumnRenamed("g", "rk")


def _versions(spark, sf):
    """One DAG per region: every nation has its trees' versions as alternatives.

    Levels version -> group -> customer with content ids, so equal versions and
    equal groups are shared nodes.
    """
    g = tables.customer_groups(spark, sf)
    group = g.groupBy("rk", "nk", "t", "grp").agg(set_key(F.col("k")).alias("key"))
    version = group.groupBy("rk", "nk", "t").agg(set_key(F.col("key")).alias("split"))
    arcs = (
        group.join(version, ["rk", "nk", "t"])
        .groupBy("rk", "nk", "split", "key").agg(F.min("t").alias("t"))
    )
    top = arcs.select("rk", "nk", "split").distinct().join(
        g.where("t = 'A'").groupBy("rk", "nk").agg(set_key(F.col("k")).alias("key")), ["rk", "nk"]
    )
    return arcs, top


def _version_levels(arcs, top):
    group_level = arcs.select(
        F.col("rk"), F.col("split").alias("parent_id"), F.col("key").alias("child_id"),
        F.xxhash64("key").alias("clade_index"), "key", "nk",
    )
    top_level = top.select(
        F.col("rk"), F.col("rk").alias("parent_id"), F.col("split").alias("child_id"),
        F.col("nk").alias("clade_index"), "key", "nk",
    )
    return group_level, top_level


VERSIONS = f"""{GROUPS},
ver as (select distinct nv.rk, nv.nk, nv.split, cl.key, cl.sz from nv join cl on cl.rk = nv.rk and cl.nk = nv.nk and cl.t = nv.t),
alt as (select rk, nk, count(distinct split) n from ver group by 1, 2),
oth as (select a.rk, a.nk, coalesce(list_reduce(list(b.n), lambda x, y: x * y), 1) n from alt a left join alt b on b.rk = a.rk and b.nk <> a.nk group by 1, 2)
"""


@query(
    "clade_multiplicity",
    f"""with {VERSIONS},
gm as (select ver.rk, ver.key, min(ver.sz) sz, sum(oth.n) n from ver join oth on oth.rk = ver.rk and oth.nk = ver.nk group by 1, 2)
select rk, cast(sz as bigint) leaves, cast(n as bigint) trees, count(*) clades from gm group by 1, 2, 3""",
)
def clade_multiplicity(spark, sf):
    """How many trees of a region's DAG contain each group's leaf set."""
    group_level, top_level = _version_levels(*_versions(spark, sf))
    res = dp.below(
        layered(Level(group_level, "leaf"), Level(top_level, "inner"), keys=("rk",)), sr.TreeCount()
    )
    up = dp.above_counts_of_level(res, 2)
    return (
        up.groupBy("rk", F.col("node_id").alias("key")).agg(F.sum("above_n").alias("trees"))
        .groupBy("rk", F.col("key.n").alias("leaves"), F.col("trees").cast("bigint").alias("trees"))
        .agg(F.count(F.lit(1)).alias("clades"))
    )


def _rf_weighted(spark, sf):
    """Version levels with RF weights against the region's input trees, and the shift.

    The reference trees are those of ``grouping_trees``; clades above the
    nations are in every tree, so nation clades count all trees.
    """
    g = tables.customer_groups(spark, sf)
    trees = g.groupBy("rk").agg(F.count_distinct("t").cast(COUNT).alias("num_trees"))
    sets = g.groupBy("rk", "nk", "t", "grp").agg(set_key(F.col("k")).alias("key")).select("rk", "key", "t")
    nations = g.groupBy("rk", "nk", "t").agg(set_key(F.col("k")).alias("key")).select("rk", "key", "t")
    mult = sets.unionByName(nations).groupBy("rk", "key").agg(F.count(F.lit(1)).cast(COUNT).alias("trees"))
    group_level, top_level = _version_levels(*_versions(spark, sf))
    low = rf.rf_weights(group_level, mult, trees, ["rk"])
    high = rf.rf_weights(top_level, mult, trees, ["rk"])
    levels = layered(Level(low, "leaf"), Level(high, "inner"), keys=("rk",))
    return levels, rf.rf_shift(mult, ["rk"])


RF_VERSIONS = f"""{GROUPS},
ver as (select distinct nv.rk, nv.nk, nv.split, cl.key from nv join cl on cl.rk = nv.rk and cl.nk = nv.nk and cl.t = nv.t),
nk_key as (select distinct rk, nk, md5(string_agg(cast(k as varchar), ',' order by k)) key from g group by rk, nk, t),
mult as (select rk, key, count(*) n from (select rk, key from cl union all select g.rk, md5(string_agg(cast(k as varchar), ',' order by k)) from g group by g.rk, nk, t) group by 1, 2),
vw as (select ver.rk, ver.nk, ver.split, sum(4 - 2 * mult.n) w from ver join mult on mult.rk = ver.rk and mult.key = ver.key group by 1, 2, 3),
vt as (select vw.rk, vw.nk, vw.split, vw.w + 4 - 2 * mult.n w from vw join nk_key on nk_key.rk = vw.rk and nk_key.nk = vw.nk join mult on mult.rk = vw.rk and mult.key = nk_key.key),
sh as (select rk, sum(n) s from mult group by rk)
"""


@query(
    "sum_rf_range",
    f"""with {RF_VERSIONS},
lo as (select rk, nk, min(w) lo, max(w) hi from vt group by 1, 2)
select lo.rk, cast(sum(lo) + min(s) as bigint) least, cast(sum(hi) + min(s) as bigint) most from lo join sh on sh.rk = lo.rk group by 1""",
)
def sum_rf_range(spark, sf):
    """Least and largest sum of RF distances to the input trees over all DAG trees."""
    levels, shift = _rf_weighted(spark, sf)
    lo = dp.below(levels, rf.best_sum_rf()).top.select("rk", F.col("w").alias("lo"))
    hi = dp.below(levels, rf.best_sum_rf(True)).top.select("rk", F.col("w").alias("hi"))
    return lo.join(hi, "rk").join(shift, "rk").select(
        "rk", *[(F.col(c) + F.col("shift")).cast("bigint").alias(name) for c, name in (("lo", "least"), ("hi", "most"))]
    )


def _rf_hist_sql():
    sql, prev = [], "seed"
    for i in range(25):
        sql.append(
            f"h{i} as (select p.rk, p.w + coalesce(v.w, 0) w, sum(p.n * coalesce(v.n, 1)) n from {prev} p "
            f"left join (select rk, w, count(*) n from vt where nk = {i} group by 1, 2) v on v.rk = p.rk group by 1, 2)"
        )
        prev = f"h{i}"
    return ",\n".join(sql), prev


_HIST, _LAST = _rf_hist_sql()


@query(
    "rf_histogram",
    f"""with {RF_VERSIONS}, seed as (select distinct rk, 0 w, 1 n from vt),
{_HIST}
select h.rk, cast(h.w + s as bigint) rf_sum, cast(h.n as bigint) trees from {_LAST} h join sh on sh.rk = h.rk""",
)
def rf_histogram(spark, sf):
    """Number of DAG trees per sum of RF distances to the input trees."""
    levels, shift = _rf_weighted(spark, sf)
    low, high = levels.levels
    below = dp.below(layered(low, keys=("rk",)), rf.best_sum_rf())
    versions = below.top.select("rk", F.col("node_id").alias("child_id"), F.col("w").alias("below_w"))
    alternatives = cut(high.edges.join(versions, ["rk", "child_id"]), "versions")
    ops = sr.Histogram(F.col("rf_w") + F.col("below_w"), count_type="bigint")
    res = dp.below(layered(Level(alternatives, "leaf"), keys=("rk",)), ops)
    return res.top.join(shift, "rk").select(
        "rk", (F.col("w") + F.col("shift")).cast("bigint").alias("rf_sum"), F.col("n").cast("bigint").alias("trees")
    )


@query(
    "validation_report",
    """with p as (select o_custkey p, count(distinct o_orderpriority) n, min(cast(substr(o_orderpriority, 1, 1) as int)) lo, max(cast(substr(o_orderpriority, 1, 1) as int)) hi from orders group by 1),
f as (select l_orderkey p, count(distinct l_returnflag) n, min(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end) lo, max(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end) hi from lineitem group by 1)
select 7 "check", 'clade indices are not contiguous' detail, count(*) n from (select * from p where lo <> 1 or hi <> n union all select * from f where lo <> 1 or hi <> n)""",
)
def validation_report(spark, sf):
    """Traversal-free checks on the orders forest seen as one DAG."""
    lines, orders = tables.orders_forest(spark, sf).levels

    def named(df, up, down):
        return df.select(
            F.lit("forest").alias("dag_id"), F.concat(F.lit(up), F.col("parent_id")).alias("parent_id"),
            F.concat(F.lit(down), F.col("child_id")).alias("child_id"), "clade_index",
        )

    edges = named(lines.edges, "o", "l").unionByName(named(orders.edges, "c", "o"))
    roots = orders.edges.select(F.concat(F.lit("c"), F.col("parent_id")).alias("r")).distinct().select(
        F.lit("forest").alias("dag_id"), F.lit("ua").alias("parent_id"), F.col("r").alias("child_id"),
        F.lit(0).alias("clade_index"),
    )
    edges = edges.unionByName(roots)

    def kind(df, name):
        return df.distinct().select("dag_id", "node_id", F.lit(name).alias("kind"))

    leaves = kind(edges.where(F.col("child_id").startswith("l")).select("dag_id", F.col("child_id").alias("node_id")), "leaf")
    inner = kind(
        edges.where(F.col("parent_id") != "ua").select("dag_id", F.col("parent_id").alias("node_id"))
        .unionByName(edges.where(F.col("child_id").startswith("o")).select("dag_id", F.col("child_id").alias("node_id"))),
        "inner",
    )
    ua = roots.select("dag_id", F.col("parent_id").alias("node_id")).distinct().select(
        "dag_id", "node_id", F.lit("ua").alias("kind")
    )
    refs = ua.select("dag_id")
    dag = HistoryDag(leaves.unionByName(inner).unionByName(ua), edges, refs)
    return validate.edge_checks(dag).groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cheapest_orders",
    """select o_orderkey, round(o_totalprice, 2) price from orders order by o_totalprice, o_orderkey limit 25""",
)
def cheapest(spark, sf):
    return diverse.top_k(
        tables.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"]
    ).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query(
    "smallest_lines_with_ties",
    """select l_orderkey, l_linenumber, cast(l_quantity as bigint) q, count(*) copies from lineitem
where l_quantity <= (select max(l_quantity) from (select l_quantity from lineitem order by l_quantity limit 100)) group by 1, 2, 3""",
)
def smallest_lines(spark, sf):
    li = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return diverse.top_k_with_ties(li, "l_quantity", 100).groupBy(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q")
    ).agg(F.count(F.lit(1)).alias("copies"))
