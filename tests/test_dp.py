import math
import random

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import dp, levels, semiring as sr
from tests import graphs as g


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    cases = {f"r{i}": g.random_dag(rng, 4 + i % 3) for i in range(6)}
    cases["w"] = g.WEIGHTED
    dag = g.build(spark, cases)
    return cases, dag, levels.rank_edges(dag)


def top(result, col):
    return {r["dag_id"]: r[col] for r in result.top.collect()}


def truth(cases, f):
    return {k: f([sum(g.edge_cost(v, i) for i in t) for t in g.trees_of(v[2])]) for k, v in cases.items()}


def test_best_weights_and_counts(world):
    cases, _, lv = world
    assert top(dp.below(lv, sr.BestWeight()), "w") == truth(cases, min)
    assert top(dp.below(lv, sr.BestWeight(largest=True)), "w") == truth(cases, max)
    assert top(dp.below(lv, sr.TreeCount()), "n") == truth(cases, len)
    best = dp.below(lv, sr.BestCount())
    assert top(best, "n") == truth(cases, lambda ws: ws.count(min(ws)))
    assert top(best, "w") == truth(cases, min)


def test_histogram(world):
    cases, _, lv = world
    got = {}
    for r in dp.below(lv, sr.Histogram()).top.collect():
        got.setdefault(r["dag_id"], {})[r["w"]] = int(r["n"])
    assert got == truth(cases, lambda ws: {w: ws.count(w) for w in set(ws)})


def test_edge_optimum_and_above(world):
    cases, _, lv = world
    res = dp.below(lv, sr.BestWeight())
    up = dp.above(res)
    got = {(r["dag_id"], r["edge_id"]): r["through_w"] for r in up.edges.collect()}
    want = {}
    for k, v in cases.items():
        for t in g.trees_of(v[2]):
            w = sum(g.edge_cost(v, i) for i in t)
            for i in t:
                want[k, i] = min(w, want.get((k, i), w))
    assert got == want
    leaf_above = {}
    for r in up.nodes.collect():
        leaf_above.setdefault((r["dag_id"], r["node_id"]), []).append(r["above_w"])
    assert all(len(v) == 1 for v in leaf_above.values())
    best = truth(cases, min)
    for k, v in cases.items():
        parents = {a[0] for a in v[2]}
        for n in v[1]:
            if n not in parents:
                assert leaf_above[k, n][0] == best[k]


def test_above_counts(world):
    cases, _, lv = world
    res = dp.below(lv, sr.TreeCount())
    up = {(r["dag_id"], r["node_id"]): r["above_n"] for r in dp.above_counts(res).collect()}
    below = {(r["dag_id"], r["node_id"]): r["n"] for r in res.nodes.collect()}
    for k, v in cases.items():
        for n in v[1]:
            through = sum(any(v[2][i][1] == n for i in t) for t in g.trees_of(v[2]))
            assert up[k, n] * below.get((k, n), 1) == through


def test_stored_weights(spark):
    dag = g.build(spark, {"w": g.WEIGHTED, "t": g.TIED})
    lv = levels.rank_edges(dag)
    ops = sr.BestWeight(sr.stored_weight(), dtype="double", tolerant=True)
    res = dp.below(lv, ops)
    assert top(res, "w") == {"w": 3.5, "t": 1.5}
    up = dp.above(res).edges.where("dag_id = 'w'").collect()
    assert all(r["through_w"] == (3.5 if r["edge_weight"] < 2 else 30.5) for r in up)
    assert res.best_edges().where("dag_id = 't'").count() == 3


def wide(clades, alternatives):
    """A UA, one node with so many clades, and as many leaves per clade; weight 1 on every edge."""
    ref, arcs, seqs = "AAAA", [(0, 1, 0, 1)], {1: "AAAA"}
    n = 2
    for c in clades:
        for _ in range(alternatives):
            seqs[n] = "CAAA"
            arcs.append((1, n, c, 1))
            n += 1
    return ref, seqs, arcs, {}


def test_histogram_of_many_and_sparse_clades(spark):
    dag = g.build(spark, {"sparse": wide([0, 70], 1), "many": wide(range(90), 2), "one": wide([3], 5)})
    got = {(r["dag_id"], r["w"]): int(r["n"]) for r in dp.below(levels.rank_edges(dag), sr.Histogram()).top.collect()}
    assert got == {("sparse", 2): 1, ("many", 90): 2**90, ("one", 1): 5}
    with pytest.raises(Exception, match="beyond the given number"):
        dp.below(levels.rank_edges(dag), sr.Histogram(clades=64)).top.collect()


def test_counts_of_any_size_have_logarithms(spark):
    dag = g.build(spark, {"big": wide(range(250), 3), "small": wide(range(3), 4)})
    lv = levels.rank_edges(dag)
    got = top(dp.below(lv, sr.TreeLogCount()), "log_n")
    assert got["big"] == pytest.approx(250 * math.log(3)) and got["small"] == pytest.approx(math.log(64))
    assert top(dp.below(lv, sr.TreeCount()), "n") == {"big": None, "small": 64}
