import random

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import validate
from cladeloom.plans import search
from cladeloom.plans.options import ReportOptions, SearchOptions, WalkOptions
from tests import graphs as g


@pytest.fixture(scope="module")
def case():
    return g.random_dag(random.Random(23), 6)


def test_sampled_trees_are_optimal_and_members(spark, case):
    dag = g.build(spark, {"r": case})
    trees = search.sample_trees(dag, 40, 3, "parsimony", uniform=True, refit=False)
    got = {}
    for r in trees.edges.collect():
        got.setdefault(r["dag_id"], set()).add(r["edge_id"])
    ts = [frozenset(t) for t in g.trees_of(case[2])]
    cost = {t: sum(g.edge_cost(case, i) for i in t) for t in ts}
    best = {t for t in ts if cost[t] == min(cost.values())}
    assert len(got) == 40 and {frozenset(v) for v in got.values()} <= best


def test_uniform_sampling_is_even_over_trees(spark):
    dag = g.build(spark, {"t": g.TIED})
    trees = search.sample_trees(dag, 2000, 5, "edge-weight", uniform=True, refit=False)
    n = trees.edges.where("child_id = 2").count()
    assert 800 < n < 1200


def test_uniform_sampling_across_a_subtree_of_too_many_trees(spark):
    """Two alternatives: a node of 3^90 trees against one of 1 tree; the first is drawn."""
    seqs, arcs, n = {1: "AAAA", 2: "AAAA", 3: "AAAA"}, [(0, 1, 0, 1), (1, 2, 0, 1), (1, 3, 0, 1)], 10
    for clade in range(90):
        for k in range(3):
            seqs[n] = "CAAA"
            arcs.append((2, n, clade, 1))
            n += 1
        seqs[n] = "CAAA"
        arcs.append((3, n, clade, 1))
        n += 1
    dag = g.build(spark, {"big": ("AAAA", seqs, arcs, {})})
    trees = search.sample_trees(dag, 6, 5, "random", uniform=True, refit=False)
    assert trees.edges.where("parent_id = 1 and child_id = 2").count() == 6


def test_search_lowers_and_is_reproducible(spark):
    dag = g.build(spark, {"m": g.MOVES})
    options = SearchOptions(iterations=1, max_radius=4, max_moves=5)
    out, history = search.optimise(dag, options)
    assert history[0] < 8
    assert validate.edge_checks(out).count() == 0
    again, second = search.optimise(dag, options)
    assert history == second
    shape = lambda d: sorted((r["parent_id"], r["child_id"]) for r in d.edges.collect())
    assert shape(out) == shape(again)


def test_walk_respects_best_moves(spark):
    dag = g.build(spark, {"m": g.MOVES})
    end, emitted = search.walk(search.fitch.fitch_assign(dag), WalkOptions(max_steps=2, radius=4, accept_threshold=-1), 1)
    assert search.tree_scores(end).first()["mutations"] < 8 and len(emitted) == 1


def test_option_checks():
    for bad in (dict(method="nope"), dict(trim=True, diverse=2), dict(method="random", drift_rounds=1),
                dict(likelihood_coeff=1.0), dict(strategy="random", drift_rounds=1), dict(method="ml")):
        with pytest.raises(ValueError):
            SearchOptions(**bad)
    with pytest.raises(ValueError):
        ReportOptions(edge_penalties="parsimony", trim="parsimony")
    p = search.Patience(2)
    assert [p.done(v) for v in (5, 5, 4, 4, 4)] == [False, False, False, False, True]


def test_second_cut_all_moves_and_own_producer(spark):
    dag = g.build(spark, {"m": g.MOVES})
    asked = []

    def producer(index, radius, threshold):
        asked.append((radius, threshold))
        return search.spr.find_moves(index, radius, threshold)

    own, history = search.optimise(dag, SearchOptions(max_radius=2, max_moves=0, producer=producer))
    assert asked and history[0] <= 8
    rows = [("x#0#a", 3.0), ("x#0#b", 1.0), ("x#0#c", 2.0), ("y#0#a", 9.0)]
    scored = spark.createDataFrame(rows, "dag_id string, final double")
    kept = lambda k: sorted(r["dag_id"] for r in search._best_fragments(scored, k).collect())
    assert kept(2) == ["x#0#b", "x#0#c", "y#0#a"] and len(kept(0)) == 4


def test_random_strategy_and_rf_samples(spark):
    dag = g.build(spark, {"m": g.MOVES})
    out, history = search.optimise(dag, SearchOptions(strategy="random", random_attempts=20, random_keep=3))
    assert history and validate.edge_checks(out).count() == 0
    tied = g.build(spark, {"t": g.TIED})
    for method in ("parsimony-ua-free", "rf-min"):
        trees = search.sample_trees(tied, 2, 1, method, refit=False)
        assert trees.refs.count() == 2
