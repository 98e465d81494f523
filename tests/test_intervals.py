"""Euler intervals, ancestor tests, running totals and incremental farthest-first against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import diverse, intervals, rf


def random_trees(rng):
    """(dag_id, node, parent) rows: a path, a star, single nodes and random trees."""
    rows = [("path", i, i - 1 if i else None) for i in range(70)] + [("star", i, 0 if i else None) for i in range(150)] + [("one", 5, None)]
    for t in range(4):
        ids = rng.sample(range(1000), 60)
        rows += [(f"r{t}", ids[i], ids[rng.randrange(i)] if i else None) for i in range(60)]
    rng.shuffle(rows)
    return rows


def test_intervals_against_parent_links(spark):
    rng = random.Random(1)
    rows = random_trees(rng)
    up = {(d, n): p for d, n, p in rows}
    df = spark.createDataFrame(rows, "dag_id string, node_id long, parent_id long")
    got = {(r.dag_id, r.node_id): (r.enter, r.leave) for r in intervals.euler_intervals(df, ["dag_id"]).collect()}
    assert got.keys() == up.keys()
    above = set()
    for d, n in up:
        p = up[d, n]
        while p is not None:
            above.add((d, p, n))
            p = up[d, p]
    sizes = Counter((d, a) for d, a, _ in above)
    trees = defaultdict(list)
    for (d, n), (enter, leave) in got.items():
        trees[d].append(n)
        assert leave - enter - 1 == sizes[d, n]
    for d, nodes in trees.items():
        assert sorted(got[d, n][0] for n in nodes) == list(range(len(nodes)))
        assert {(d, a, b) for a in nodes for b in nodes if got[d, a][0] < got[d, b][0] < got[d, a][1]} == {x for x in above if x[0] == d}
    pairs = spark.createDataFrame([(d, rng.choice(n), rng.choice(n)) for d, n in trees.items() for _ in range(20)], "dag_id string, a long, b long")
    spans = intervals.euler_intervals(df, ["dag_id"])
    told = intervals.with_intervals(pairs, spans, ["dag_id"], "a", "b").withColumn("above", intervals.is_above("a", "b")).collect()
    assert len(told) == pairs.count() and all(r.above == ((r.dag_id, r.a, r.b) in above) for r in told)
    roots = spark.createDataFrame([(d, rng.choice(n)) for d, n in trees.items()], "dag_id string, node_id long")
    below = {tuple(r) for r in intervals.strictly_below(spans, roots, ["dag_id"]).collect()}
    assert below == {(d, n) for d, a in map(tuple, roots.collect()) for x, y, n in above if (x, y) == (d, a)}
    assert intervals.euler_intervals(df.where("dag_id = 'path'").drop("dag_id"), []).count() == 70
    assert intervals.euler_intervals(df.limit(0), ["dag_id"]).count() == 0


def test_shallow_trees_are_numbered_by_level(spark, monkeypatch):
    rows = [r for r in random_trees(random.Random(4)) if r[0] != "path"]
    df = spark.createDataFrame(rows, "dag_id string, node_id long, parent_id long")
    tour = {tuple(r) for r in intervals._by_tour(df, ["dag_id"]).collect()}
    monkeypatch.setattr(intervals, "list_ranks", None)  # nothing is doubled
    assert {tuple(r) for r in intervals.euler_intervals(df, ["dag_id"]).collect()} == tour
    loose = df.where("parent_id is not null or dag_id <> 'star'")
    with pytest.raises(ValueError):
        intervals.euler_intervals(loose, ["dag_id"])


def test_list_ranks_of_many_lists(spark):
    rows, want = [], {}
    for key in range(5):
        n, total = 1 + 13 * key, 0
        for i in range(n - 1, -1, -1):
            total += i % 3
            rows.append((key, i, i + 1 if i + 1 < n else None, i % 3))
            want[key, i] = total
    df = spark.createDataFrame(rows, "k int, item long, next long, weight long")
    assert {(r.k, r["item"]): r.total for r in intervals.list_ranks(df, ["k"]).collect()} == want


def test_running_total_over_runs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(200), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, place long, n long")
    for r in intervals.running_total(df, ["k"], "place", "n", width=16).collect():
        assert r.before == sum(n for k, p, n in rows if k == r.k and p < r.place)


def test_farthest_first_equals_the_matrix(spark):
    rng = random.Random(3)
    rows = [("g%d" % g, f"t{t}", f"k{rng.randrange(12)}") for g in range(3) for t in range(9) for _ in range(rng.randrange(1, 9))]
    clades = spark.createDataFrame(rows, "g string, dag_id string, key string")
    extra = clades.select("g", "dag_id").distinct().unionByName(clades.select("g", F.lit("alone").alias("dag_id")).distinct())
    far = defaultdict(dict)
    for r in rf.pairwise_rf(clades).collect():
        far[r.g][r.t1, r.t2] = far[r.g][r.t2, r.t1] = r.rf
    got = defaultdict(list)
    for r in diverse.farthest_first(clades, 4).orderBy("g", "rank").collect():
        got[r.g].append((r.tree, r.gap))
    for g, d in far.items():
        trees = sorted({a for a, _ in d})
        total = {t: sum(d[t, x] for x in trees if x != t) for t in trees}
        picks = [min(trees, key=lambda t: (-total[t], t))]
        gaps = [total[picks[0]]]
        while len(picks) < 4:
            rest = [t for t in trees if t not in picks]
            key = {t: (min(d[t, p] for p in picks), sum(d[t, p] for p in picks)) for t in rest}
            picks.append(min(rest, key=lambda t: (-key[t][0], -key[t][1], t)))
            gaps.append(key[picks[-1]][0])
        assert got[g] == list(zip(picks, gaps))
    with_alone = diverse.farthest_first(clades, 10, trees=extra).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("tree") == "alone", 1)).alias("seen"))
    assert all(r.seen == 1 for r in with_alone.collect())
