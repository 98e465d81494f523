"""Dynamic programs over the orders forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT
from cladeloom.functions.bigcount import exact_products
from cladeloom.operators import dp, sampling, semiring as sr
from cladeloom.operators.levels import Level, layered
from cladeloom.plans import tables
from cladeloom.plans.registry import FOREST, query


def weight():
    return F.col("edge_weight")


def _top(result, *cols):
    return result.top.select(F.col("node_id").alias("ck"), *cols)


@query("min_weight_per_customer", f"with {FOREST} select ck, tot w from ct")
def min_weight(spark, sf):
    return _top(dp.below(tables.orders_forest(spark, sf), sr.BestWeight(weight())), "w")


@query("max_weight_per_customer", f"with {FOREST} select ck, tox w from ct")
def max_weight(spark, sf):
    return _top(dp.below(tables.orders_forest(spark, sf), sr.BestWeight(weight(), largest=True)), "w")


@query("tree_count_per_customer", f"with {FOREST} select ck, n from ct")
def tree_count(spark, sf):
    return _top(
        dp.below(tables.orders_forest(spark, sf), sr.TreeCount()), F.col("n").cast("bigint").alias("n")
    )


@query(
    "optimal_tree_count_per_customer",
    f"""with {FOREST},
bl as (select le.ok, le.cl, count(*) n from le join lc on lc.ok = le.ok and lc.cl = le.cl and le.w = lc.cw group by 1, 2),
bo as (select ok, list_reduce(list(n), lambda a, b: a * b) n from bl group by ok),
bc as (select oe.ck, oe.cl, cast(sum(bo.n) as bigint) n from oe join oc on oc.ck = oe.ck and oc.cl = oe.cl and oe.w = oc.cw
       join bo on bo.ok = oe.ok group by 1, 2),
bt as (select ck, list_reduce(list(n), lambda a, b: a * b) n from bc group by ck)
select ct.ck, tot w, bt.n from ct join bt on bt.ck = ct.ck""",
)
def optimal_count(spark, sf):
    return _top(
        dp.below(tables.dealt_forest(spark, sf), sr.BestCount(weight())),
        "w", F.col("n").cast("bigint").alias("n"),
    )


@query(
    "best_edges",
    f"""with {FOREST}
select 'line' lvl, le.ok parent, le.cl, le.w, count(*) copies from le join lc on lc.ok = le.ok and lc.cl = le.cl and le.w = lc.cw group by 1, 2, 3, 4
union all
select 'order', oe.ck, oe.cl, oe.w, count(*) from oe join oc on oc.ck = oe.ck and oc.cl = oe.cl and oe.w = oc.cw group by 1, 2, 3, 4""",
)
def best_edges(spark, sf):
    res = dp.below(tables.orders_forest(spark, sf), sr.BestWeight(weight()))
    parts = []
    for name, e, c in zip(("line", "order"), res.edge_parts, res.clade_parts):
        best = dp.best_of(e, c, res.keys, res.ops)
        parts.append(
            best.groupBy(F.lit(name).alias("lvl"), F.col("parent_id").alias("parent"),
                         F.col("clade_index").alias("cl"), "w").agg(F.count(F.lit(1)).alias("copies"))
        )
    return parts[0].unionByName(parts[1])


PENALTIES = f"""{FOREST},
ab as (select oe.ck, oe.ok, oe.cl, oe.w, ct.tot, ct.tot - oc.cw + oe.w score, ct.tot - oc.cw + 1 above
       from oe join oc on oc.ck = oe.ck and oc.cl = oe.cl join ct on ct.ck = oe.ck),
pe as (select 'order' lvl, ck, ok, cl, w, score, score - tot penalty from ab
       union all
       select 'line', ab.ck, ab.ok, le.cl, le.w, above + ob.ow - lc.cw + le.w, above + ob.ow - lc.cw + le.w - tot
       from ab join ob on ob.ok = ab.ok join le on le.ok = ab.ok join lc on lc.ok = le.ok and lc.cl = le.cl)
"""


def _penalties(spark, sf):
    """Per level, orders first: edges with the best weight through them and how far it is from their customer's optimum."""
    levels = tables.dealt_forest(spark, sf)
    res = dp.below(levels, sr.BestWeight(weight()), keep=True)
    up = dp.above(res)
    best = res.top.select(F.col("node_id").alias("ck"), F.col("w").alias("best_w"))
    owner = levels.levels[1].edges.select(F.col("child_id").alias("ok"), F.col("parent_id").alias("ck")).join(best, "ck")
    held = [F.col("clade_index").alias("cl"), "w", F.col("through_w").alias("score")]
    orders = up.edge_parts[0].select(F.col("parent_id").alias("ck"), F.col("child_id").alias("ok"), *held)
    lines = up.edge_parts[1].select(F.col("parent_id").alias("ok"), *held)
    # One part per level: orders met by customer, lines by order, where their groups are complete.
    parts = (("order", orders.join(best, "ck")), ("line", levels.dealt(lines, "ok").join(levels.dealt(owner, "ok"), "ok")))
    return [
        df.select(F.lit(lvl).alias("lvl"), "ck", "ok", "cl", "w", "score", (F.col("score") - F.col("best_w")).alias("penalty"))
        for lvl, df in parts
    ]


@query(
    "edge_penalties",
    f"with {PENALTIES} select lvl, ck, ok, cl, cast(w as bigint) w, cast(score as bigint) score, cast(penalty as bigint) penalty, count(*) copies from pe group by 1, 2, 3, 4, 5, 6, 7",
)
def edge_penalties(spark, sf):
    cols = ["lvl", "ck", "ok", "cl", "w", "score", "penalty"]
    orders, lines = [df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")) for df in _penalties(spark, sf)]
    return orders.unionByName(lines)


@query(
    "penalty_summary",
    f"with {PENALTIES} select lvl, count(*) edges, count(*) filter (where penalty = 0) zero, count(*) filter (where penalty > 0) positive, cast(max(penalty) as bigint) largest from pe group by lvl",
)
def penalty_summary(spark, sf):
    orders, lines = _penalties(spark, sf)
    return dp.penalty_summary(orders.unionByName(lines), ["lvl"])


@query(
    "min_discount_with_ties",
    """with lc as (select l_orderkey ok, l_returnflag cl, min(l_discount) cw from lineitem group by 1, 2),
tie as (select l_orderkey ok, count(*) n from lineitem join lc on lc.ok = l_orderkey and lc.cl = l_returnflag
        where l_discount <= cw + 1e-10 + 1e-10 * greatest(1.0, abs(cw)) group by 1)
select lc.ok, round(sum(cw), 6) w, max(tie.n) best_lines from lc join tie on tie.ok = lc.ok group by 1""",
)
def min_discount(spark, sf):
    line = tables.line_edges(spark, sf)
    ops = sr.BestWeight(F.col("discount"), dtype="double", tolerant=True)
    res = dp.below(layered(Level(line, "leaf")), ops)
    ties = res.best_edges().groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("best_lines")
    )
    return res.top.join(ties, "node_id").select(
        F.col("node_id").alias("ok"), F.round("w", 6).alias("w"), "best_lines"
    )


@query(
    "min_weight_without_root_edges",
    f"""with {FOREST}, uc as (select ck, cl, min(w - 1) cw from oe group by ck, cl)
select ck, cast(sum(cw) as bigint) w from uc group by ck""",
)
def min_weight_off_root(spark, sf):
    lines, orders = tables.orders_forest(spark, sf).levels
    lv = layered(
        Level(lines.edges.withColumn("parent_is_ua", F.lit(False)), "leaf"),
        Level(orders.edges.withColumn("parent_is_ua", F.lit(True)), "inner"),
    )
    return _top(dp.below(lv, sr.BestWeight(F.when(F.col("parent_is_ua"), 0).otherwise(weight()))), "w")


@query(
    "line_histogram_per_order",
    """with h as (select l_orderkey ok, l_returnflag cl, cast(l_linenumber as bigint) w, count(*) n from lineitem group by 1, 2, 3),
o as (select distinct ok from h),
a as (select ok, w, n from h where cl = 'A' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'A')),
b as (select ok, w, n from h where cl = 'N' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'N')),
c as (select ok, w, n from h where cl = 'R' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'R'))
select a.ok, cast(a.w + b.w + c.w as bigint) w, cast(sum(a.n * b.n * c.n) as bigint) n
from a join b on b.ok = a.ok join c on c.ok = a.ok group by 1, 2""",
)
def line_histogram(spark, sf):
    lv = layered(Level(tables.line_edges(spark, sf), "leaf"))
    res = dp.below(lv, sr.Histogram(F.col("line_number"), clades=3, count_type="bigint"))
    return res.top.select(F.col("node_id").alias("ok"), "w", F.col("n").cast("bigint").alias("n"))


def _conv(parts, name):
    """SQL that convolves clade histograms with (ck, cl, w, n) rows, one clade after the other."""
    sql, prev = [], "seed"
    for i in parts:
        sql.append(
            f"{name}{i} as (select p.ck, p.w + coalesce(h.w, 0) w, sum(p.n * coalesce(h.n, 1)) n "
            f"from {prev} p left join (select * from oh where cl = {i}) h on h.ck = p.ck group by 1, 2)"
        )
        prev = f"{name}{i}"
    return ",\n".join(sql), prev


_STEPS, _LAST = _conv(range(5), "s")


@query(
    "weight_histogram",
    f"""with h as (select l_orderkey ok, l_returnflag cl, cast(l_linenumber as bigint) w, count(*) n from lineitem group by 1, 2, 3),
o as (select distinct ok from h),
a as (select ok, w, n from h where cl = 'A' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'A')),
b as (select ok, w, n from h where cl = 'N' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'N')),
c as (select ok, w, n from h where cl = 'R' union all select ok, 0, 1 from o where ok not in (select ok from h where cl = 'R')),
od as (select a.ok, a.w + b.w + c.w w, sum(a.n * b.n * c.n) n from a join b on b.ok = a.ok join c on c.ok = a.ok group by 1, 2),
oh as (select o_custkey ck, cast(substr(o_orderpriority, 1, 1) as int) - 1 cl, od.w + 1 w, sum(od.n) n
       from orders join od on od.ok = o_orderkey group by 1, 2, 3),
seed as (select distinct ck, 0 w, 1 n from oh),
{_STEPS}
select cast(w as bigint) w, count(*) customers, cast(max(n) as bigint) most, cast(sum(n) as bigint) trees from {_LAST} group by w""",
)
def weight_histogram(spark, sf):
    """Distribution of tree weights of every customer, summed per weight."""
    res = dp.below(tables.orders_forest(spark, sf), sr.Histogram(F.col("line_number"), clades=5, count_type="bigint"))
    return res.top.groupBy("w").agg(
        F.count(F.lit(1)).alias("customers"),
        F.max("n").cast("bigint").alias("most"),
        F.sum("n").cast("bigint").alias("trees"),
    )


@query(
    "trees_through_order",
    f"""with {FOREST}
select oe.ok, cast(oe.n as bigint) below_n, cast(ct.n // oc.n as bigint) above_n, cast(ct.n // oc.n * oe.n as bigint) trees
from oe join oc on oc.ck = oe.ck and oc.cl = oe.cl join ct on ct.ck = oe.ck""",
)
def trees_through(spark, sf):
    res = dp.below(tables.orders_forest(spark, sf), sr.TreeCount())
    up = dp.above_counts_of_level(res, 1)
    below = res.node_parts[0].select("node_id", "n")
    return up.join(below, "node_id").select(
        F.col("node_id").alias("ok"), F.col("n").cast("bigint").alias("below_n"),
        F.col("above_n").cast("bigint").alias("above_n"),
        (F.col("n") * F.col("above_n")).cast("bigint").alias("trees"),
    )


@query(
    "subtree_sizes",
    """with l as (select l_orderkey ok, count(*) n from lineitem group by 1)
select o_custkey ck, cast(sum(n) as bigint) leaves, cast(sum(n + 1) + 1 as bigint) nodes, 2 depth
from orders join l on l.ok = o_orderkey group by 1""",
)
def subtree_sizes(spark, sf):
    return _top(dp.below(tables.orders_forest(spark, sf), sr.SubtreeSize()), "leaves", "nodes", "depth")


PICK = "md5(concat_ws('|', '7', '0', cast({} as varchar)))"


@query(
    "sampled_tree",
    f"""with p as (select o_custkey ck, min_by(o_orderkey, {PICK.format('o_orderkey')}) ok from orders
          where o_orderkey in (select l_orderkey from lineitem) group by o_custkey, o_orderpriority),
l as (select l_orderkey ok, l_returnflag cl, min_by(l_partkey, {PICK.format("concat_ws('|', cast(l_partkey as varchar), cast(l_suppkey as varchar), cast(l_linenumber as varchar))")}) part
      from lineitem group by 1, 2)
select p.ck, p.ok, l.cl, l.part from p join l on l.ok = p.ok""",
)
def sampled_tree(spark, sf):
    """One tree per customer, alternatives equally likely, by reproducible keys."""
    li = tables.table(spark, sf, "lineitem")
    orders = tables.table(spark, sf, "orders").join(
        li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"
    )
    draw = F.lit(0)
    top = sampling.choose(
        orders, ["o_custkey", "o_orderpriority"],
        sampling.edge_uniform_key(7, draw, "o_orderkey"), ["o_orderkey"],
    )
    leaf = sampling.choose(
        li, ["l_orderkey", "l_returnflag"],
        sampling.edge_uniform_key(7, draw, "l_partkey", "l_suppkey", "l_linenumber"), ["l_partkey"],
    )
    return top.join(leaf, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ck"), F.col("o_orderkey").alias("ok"),
        F.col("l_returnflag").alias("cl"), F.col("l_partkey").alias("part"),
    )


def _picked_orders(spark, sf, ops, best_only):
    res = dp.below(tables.dealt_forest(spark, sf), ops)
    edges = res.edge_parts[1]
    if best_only:
        edges = dp.best_of(edges, res.clade_parts[1], [], ops)
    key = sampling.weighted_key(11, F.lit(0), F.col("n").cast("double"), "child_id")
    return sampling.choose(edges, ["parent_id", "clade_index"], key, ["child_id", "n"])


DRAW = "-ln((cast(('0x' || substr(md5(concat_ws('|', '11', '0', cast({} as varchar))), 1, 12)) as bigint) + 0.5) / 281474976710656.0)"


@query(
    "tree_uniform_sample",
    f"""with {FOREST}
select ck, cl, min_by(ok, {DRAW.format('ok')} / n) ok, cast(min_by(n, {DRAW.format('ok')} / n) as bigint) n from oe group by ck, cl""",
)
def tree_uniform_sample(spark, sf):
    """Orders chosen in proportion to the number of trees below them."""
    return _picked_orders(spark, sf, sr.TreeCount(), False).select(
        F.col("parent_id").alias("ck"), F.col("clade_index").alias("cl"),
        F.col("child_id").alias("ok"), F.col("n").cast("bigint").alias("n"),
    )


@query(
    "optimal_uniform_sample",
    f"""with {FOREST},
bl as (select le.ok, le.cl, count(*) n from le join lc on lc.ok = le.ok and lc.cl = le.cl and le.w = lc.cw group by 1, 2),
bo as (select ok, list_reduce(list(n), lambda a, b: a * b) n from bl group by ok),
be as (select oe.ck, oe.cl, oe.ok, bo.n from oe join oc on oc.ck = oe.ck and oc.cl = oe.cl and oe.w = oc.cw join bo on bo.ok = oe.ok)
select ck, cl, min_by(ok, {DRAW.format('ok')} / n) ok, cast(min_by(n, {DRAW.format('ok')} / n) as bigint) n from be group by ck, cl""",
)
def optimal_uniform_sample(spark, sf):
    """As tree_uniform_sample, over minimum-weight trees only."""
    return _picked_orders(spark, sf, sr.BestCount(weight()), True).select(
        F.col("parent_id").alias("ck"), F.col("clade_index").alias("cl"),
        F.col("child_id").alias("ok"), F.col("n").cast("bigint").alias("n"),
    )


@query(
    "large_tree_counts",
    f"""with recursive {FOREST},
f as (select c_nationkey nk, oc.n f, row_number() over (partition by c_nationkey order by ck, cl) i
      from oc join customer on c_custkey = ck),
r(nk, i, limbs) as (
  select distinct nk, 0::bigint, [1::hugeint] from f
  union all
  select r.nk, r.i + 1, list_reduce(
    list_prepend([0::hugeint], list_transform(limbs, lambda x: [x * f.f])),
    lambda a, b: a[:-2] || [(a[-1] + b[1]) % 1000000000, (a[-1] + b[1]) // 1000000000])
  from r join f on f.nk = r.nk and f.i = r.i + 1)
select nk, ltrim(list_aggregate(list_transform(list_reverse(limbs), lambda x: lpad(x::varchar, 9, '0')), 'string_agg', ''), '0') trees
from (select nk, arg_max(limbs, i) limbs from r group by nk)""",
)
def large_tree_counts(spark, sf):
    """Exact number of ways to pick a tree of every customer of a nation, hundreds of digits long."""
    per_customer = dp.below(tables.orders_forest(spark, sf), sr.TreeCount()).top.select(F.col("node_id").alias("c_custkey"), "n")
    nations = tables.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    return exact_products(per_customer.join(nations, "c_custkey"), "nk", "n").withColumnRenamed("product", "trees")
