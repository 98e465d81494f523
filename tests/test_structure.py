import random

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import dp, fitch, leafsets, levels, merge, rf, semiring as sr, trim, validate
from cladeloom.schema import HistoryDag
from tests import graphs as g


def test_merge_counts_and_idempotence(spark):
    dag = g.build(spark, {"a": g.SIX_A, "b": g.SIX_B, "c": g.SIX_A})
    out = merge.merge(dag)
    assert out.nodes.count() == 15 and out.edges.count() == 20
    lv = levels.rank_edges(out)
    assert [r["n"] for r in dp.below(lv, sr.TreeCount()).top.collect()] == [2]
    assert validate.validate(out).count() == 0
    again = merge.merge(out)
    assert again.nodes.count() == 15 and again.edges.count() == 20
    exact = merge.merge(dag, consistent=False)
    assert exact.nodes.count() == 15 and exact.edges.count() == 20


def test_pairwise_rf(spark):
    dag = g.build(spark, {"1": g.SIX_A, "2": g.SIX_B, "3": g.SIX_C})
    keys = leafsets.leaf_keys(leafsets.levels_with_leaves(dag))
    clades = rf.tree_clades(dag, keys.nodes).withColumn("g", F.lit(1))
    got = {(r["t1"], r["t2"]): r["rf"] for r in rf.pairwise_rf(clades).collect()}
    assert got == {("1", "2"): 6, ("1", "3"): 1, ("2", "3"): 7}


def test_sum_rf_matches_pairwise(spark):
    trees = g.build(spark, {"1": g.SIX_A, "2": g.SIX_B})
    ref = merge.merge(trees)
    lv = leafsets.levels_with_leaves(ref)
    counts = dp.below(levels.rank_edges(ref), sr.TreeCount())
    keys = leafsets.leaf_keys(lv)
    leaf_keys = keys.edges.select("dag_id", F.col("child_id").alias("node_id"), "key").distinct()
    root_keys = keys.nodes.join(
        ref.nodes.where("kind = 'ua'").select("dag_id", "node_id"), ["dag_id", "node_id"], "left_anti"
    ).select("dag_id", "node_id", "key")
    every = leaf_keys.unionByName(root_keys).distinct()
    mult = rf.clade_multiplicity(every, dp.above_counts(counts), counts.nodes, ["dag_id"])
    totals = counts.top.select("dag_id", F.col("n").alias("num_trees"))
    weighted = rf.rf_weights(keys.edges.drop("leaf_name"), mult, totals, ["dag_id"])
    shift = rf.rf_shift(mult, ["dag_id"]).first()["shift"]
    slots = ["dag_id", "parent_id", "child_id", "clade_index", "edge_id", "child_rank", "parent_rank", "rf_w"]
    from dataclasses import replace
    from cladeloom.runtime import cut
    lw = replace(lv, ranked=cut(weighted.select(*slots), "w", ("child_rank",)))
    lo = dp.below(lw, rf.best_sum_rf()).top.first()["w"] + shift
    hi = dp.below(lw, rf.best_sum_rf(True)).top.first()["w"] + shift
    assert (lo, hi) == (6, 6)


def test_trim_inconsistent(spark):
    def case(arcs):
        seqs = {1: "GAA", 2: "GAA", 3: "ACC", 4: "GTT", 5: "AAA"}
        return ("GAA", seqs, g.arcs(arcs), None)

    # 1, 2 inner; 3, 4, 5 leaves
    a = case("0>1.0 0>2.0 1>3.0 1>4.1 1>5.2 2>3.0 2>4.1")
    b = case("0>1.0 0>2.0 1>3.0 1>4.1 2>3.0 2>5.1")
    dag = g.build(spark, {"a": a, "b": b})
    bad = validate.validate(dag).collect()
    assert {(r["dag_id"], r["check"]) for r in bad} == {("a", 8), ("b", 8)}
    out, report = trim.trim_inconsistent(dag)
    got = {r["dag_id"]: (r["edges_removed"], r["unresolvable"]) for r in report.collect()}
    assert got["a"] == (1, 0)
    assert got["b"][0] == 0 and got["b"][1] >= 1
    assert out.edges.where("dag_id = 'a'").count() == 4
    assert trim.trim_inconsistent(out)[0].edges.count() == out.edges.count()


def test_validator_negatives(spark):
    seqs = {1: "GAA", 2: "ACC", 3: "GTT"}
    ok = ("GAA", seqs, g.arcs("0>1.0 1>2.0 1>3.1"), None)
    orphan = ("GAA", seqs, g.arcs("0>1.0 1>2.0"), None)
    gap = ("GAA", seqs, g.arcs("0>1.0 1>2.0 1>3.5"), None)
    dag = g.build(spark, {"ok": ok, "orphan": orphan, "gap": gap})
    got = {(r["dag_id"], r["check"]) for r in validate.validate(dag).collect()}
    assert got == {("orphan", 5), ("gap", 7)}


def test_trim_to_best_keeps_all_optima(spark):
    rng = random.Random(11)
    cases = {f"r{i}": g.random_dag(rng, 5) for i in range(4)}
    dag = g.build(spark, cases)
    res = dp.below(levels.rank_edges(dag), sr.BestWeight())
    out = trim.trim_to_best(dag, res)
    kept = {}
    for r in out.edges.collect():
        kept.setdefault(r["dag_id"], set()).add(r["edge_id"])
    for k, v in cases.items():
        ts = g.trees_of(v[2])
        cost = [sum(g.edge_cost(v, i) for i in t) for t in ts]
        want = {i for t, c in zip(ts, cost) if c == min(cost) for i in t}
        assert kept[k] == want


def brute_fitch(graph):
    ref, seqs, arcs, _ = graph
    kids = {}
    for p, c, _, _ in arcs:
        kids.setdefault(p, []).append(c)
    cost, sets = 0, {}

    def up(n):
        nonlocal cost
        if n not in kids:
            sets[n] = [{b} for b in seqs[n]]
            return
        for c in kids[n]:
            up(c)
        out = []
        for i in range(len(ref)):
            inter = set.intersection(*[sets[c][i] for c in kids[n]])
            out.append(inter or set.union(*[sets[c][i] for c in kids[n]]))
            cost += not inter
        sets[n] = out

    root = kids[0][0]
    up(root)
    chosen = {}

    def down(n, prefer):
        if n not in kids:
            return
        chosen[n] = "".join(p if p in s else min(s) for p, s in zip(prefer, sets[n]))
        for c in kids[n]:
            down(c, chosen[n])

    down(root, ref)
    return cost, chosen


def test_fitch_matches_brute_force(spark):
    rng = random.Random(3)
    cases = {"a": g.SIX_A, "b": g.SIX_B, "m": g.MOVES}
    for i in range(4):
        ref, seqs, arcs, names = g.random_dag(rng, 6, 20)
        tree = rng.choice(g.trees_of(arcs))
        used = [arcs[j] for j in tree]
        keep = {c for _, c, _, _ in used}
        cases[f"r{i}"] = (ref, {n: s for n, s in seqs.items() if n in keep}, used, names)
    dag = g.build(spark, cases)
    tree, sites, refs, words = fitch.prepare(dag)
    sets = fitch.sets_up(tree, words)
    cost = {r["dag_id"]: r["cost"] for r in sets.cost().collect()}
    out = fitch.fitch_assign(dag)
    genomes = {(r["dag_id"], r["node_id"]): [(s["pos"], s["base"]) for s in r["cg"]]
               for r in out.nodes.where("kind = 'inner'").collect()}
    muts = {r["dag_id"]: r["n"] for r in out.edges.groupBy("dag_id").agg(
        F.sum(F.size("mutations")).alias("n")).collect()}
    for k, v in cases.items():
        want_cost, chosen = brute_fitch(v)
        assert cost.get(k, 0) == want_cost
        for n, seq in chosen.items():
            assert genomes[k, n] == g.diff(seq, v[0])
        full = {**v[1], **chosen}
        assert muts[k] == sum(len(g.muts(v[0] if p == 0 else full[p], full[c])) for p, c, _, _ in v[2])


def test_novel_nodes_of_two_dags(spark):
    """Known splits of one DAG say nothing about another."""
    dag = g.build(spark, {"x": g.SIX_A, "y": g.SIX_B})
    keys = leafsets.leaf_keys(leafsets.levels_with_leaves(dag))
    other = HistoryDag(*(t.where("dag_id = 'y'").withColumn("dag_id", F.lit("x")) for t in (dag.nodes, dag.edges, dag.refs)))
    crossed = leafsets.leaf_keys(leafsets.levels_with_leaves(other))
    both = leafsets.LeafKeys(
        crossed.nodes.unionByName(keys.nodes.where("dag_id = 'x'").withColumn("dag_id", F.lit("y"))), None, None
    )
    own = {r["dag_id"]: r["novel"] for r in merge.novel_nodes(dag, keys, keys).collect()}
    assert own == {"x": 0, "y": 0}
    swapped = {r["dag_id"]: r["novel"] for r in merge.novel_nodes(dag, keys, both).collect()}
    assert swapped["x"] > 0 and swapped["y"] > 0


def ladder(n):
    """A spine of n nodes, each with a leaf of its own and a long edge back to the bottom."""
    seqs = {i: "AAAA" for i in range(1, n + 1)} | {1000 + i: "CAAA" for i in range(1, n + 1)}
    arcs = [(0, 1, 0, 1)] + [(i, i + 1, 0, 1) for i in range(1, n)] + [(i, 1000 + i, 1, 1) for i in range(1, n + 1)]
    return "AAAA", seqs, arcs + [(i, n, 2, 1) for i in range(1, n - 1)], {}


def test_ranks_of_a_ladder(spark):
    n = 24
    dag = g.build(spark, {"l": ladder(n), "six": g.SIX_A})
    high = {(r["dag_id"], r["node_id"]): r["height"] for r in levels.heights(dag).collect()}
    deep = {(r["dag_id"], r["node_id"]): r["depth"] for r in levels.depths(dag).collect()}
    assert all(high["l", i] == n + 1 - i for i in range(1, n + 1)) and high["l", 0] == n + 1
    assert len(high) == dag.nodes.count()
    below = {i: deep["l", i] - deep["l", 1] for i in range(1, n + 1)}
    assert below == {i: i - 1 for i in range(1, n + 1)}
    cycle = HistoryDag(dag.nodes, dag.edges.unionByName(
        dag.edges.where("dag_id = 'l' and parent_id = 5 and child_id = 6").withColumns({"parent_id": F.lit(9).cast("bigint"), "child_id": F.lit(4).cast("bigint")})
    ), dag.refs)
    with pytest.raises(ValueError, match="cycle"):
        levels.heights(cycle)
