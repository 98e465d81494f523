import random

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import fitch, spr
from tests import graphs as g


def cost_of(ref, seqs, kids, root):
    total = 0

    def up(n):
        nonlocal total
        if not kids.get(n):
            return [{b} for b in seqs[n]]
        below = [up(c) for c in kids[n]]
        out = []
        for col in zip(*below):
            inter = set.intersection(*col)
            total += not inter and len(col) > 1
            out.append(inter or set.union(*col))
        return out

    top = up(root)
    return total + sum(r not in s for r, s in zip(ref, top))


def moved(kids, parent, root, src, dst):
    kids = {k: list(v) for k, v in kids.items()}
    sp, dp = parent[src], parent[dst]
    if len(kids[sp]) < 2:
        return None
    kids[sp].remove(src)
    if len(kids[sp]) == 1:
        sib = kids.pop(sp)[0]
        if sp == root:
            root = sib
        else:
            up = kids[parent[sp]]
            up[up.index(sp)] = sib
        if dp == sp:
            dp = parent.get(sp)
    kids["x"] = [dst, src]
    if dst == root:
        return kids, "x"
    kids[dp][kids[dp].index(dst)] = "x"
    return kids, root


def brute_moves(graph, radius):
    ref, seqs, arcs, _ = graph
    kids, parent = {}, {}
    for p, c, _, _ in arcs:
        if p:
            kids.setdefault(p, []).append(c)
            parent[c] = p
    root = next(c for p, c, _, _ in arcs if p == 0)
    base = cost_of(ref, seqs, kids, root)
    dup = set()
    for p, cs in kids.items():
        seen = {}
        for c in sorted(c for c in cs if c not in kids):
            if seqs[c] in seen:
                dup.add(c)
            seen.setdefault(seqs[c], c)
    out = {}
    for src in seqs:
        if src == root or src in dup or len(kids[parent[src]]) < 2:
            continue
        cur, prev = parent[src], src
        for k in range(1, radius + 1):
            stack = [(c, radius - k) for c in kids[cur] if c != prev]
            while stack:
                n, left = stack.pop()
                new = moved(kids, parent, root, src, n)
                out[src, n] = cost_of(ref, seqs, *new) - base
                if left:
                    stack += [(c, left - 1) for c in kids.get(n, [])]
            if cur == root:
                break
            cur, prev = parent[cur], cur
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(5)
    cases = {"m": g.MOVES, "a": g.SIX_A, "c": g.SIX_C}
    for i in range(3):
        ref, seqs, arcs, names = g.random_dag(rng, 7, 18)
        tree = rng.choice(g.trees_of(arcs))
        used = [arcs[j] for j in tree]
        keep = {c for _, c, _, _ in used}
        cases[f"r{i}"] = (ref, {n: s for n, s in seqs.items() if n in keep}, used, names)
    dag = g.build(spark, cases)
    return cases, dag, spr.index_dag(dag)


def test_scores_match_rebuilt_trees(forest):
    cases, _, index = forest
    for radius in (2, 4):
        got = {(r["dag_id"], r["src"], r["dst"]): r["score"]
               for r in spr.score_moves(index, spr.candidate_moves(index, radius)).collect()}
        want = {(k, s, d): v for k, gr in cases.items() for (s, d), v in brute_moves(gr, radius).items()}
        assert got == want


def test_pruned_search_finds_every_improving_move(forest):
    cases, _, index = forest
    got = {(r["dag_id"], r["src"], r["dst"]): r["score"] for r in spr.find_moves(index, 4).collect()}
    want = {(k, s, d): v for k, gr in cases.items() for (s, d), v in brute_moves(gr, 4).items() if v < 0}
    assert want and got == want


@pytest.mark.parametrize("threshold", [-2, -1, 0, 1])
def test_outward_listing_loses_no_move(forest, threshold):
    cases, _, index = forest
    outward = spr.Outward(index, threshold)
    for radius in (2, 4, 8):
        found = spr.find_moves(index, radius, threshold, outward).collect()
        got = {(r["dag_id"], r["src"], r["dst"]): r["score"] for r in found}
        every = {(k, s, d): v for k, gr in cases.items() for (s, d), v in brute_moves(gr, radius).items()}
        assert len(found) == len(got) and got == {m: v for m, v in every.items() if v <= threshold}
        if threshold < 0:
            assert outward.moves(radius).count() < len(every) / 2


def test_outward_bound_on_wide_families(spark):
    rng = random.Random(11)
    cases = {}
    for i in range(4):
        ref = "".join(rng.choice("ACGT") for _ in range(20))
        pool = ["".join(b if rng.random() < 0.8 else rng.choice("ACGT") for b in ref) for _ in range(5)]
        seqs, arcs, inner = {1: ref}, [(0, 1, 0, 0.0)], [1]
        for n in range(2, 32):
            p = rng.choice(inner[:6])
            arcs.append((p, n, sum(a[0] == p for a in arcs), 0.0))
            leafy = n > 9
            seqs[n] = rng.choice(pool) if leafy else ref
            inner += [] if leafy else [n]
        for p in inner:
            while sum(a[0] == p for a in arcs) < 2:
                n = len(seqs) + 1
                arcs.append((p, n, sum(a[0] == p for a in arcs), 0.0))
                seqs[n] = rng.choice(pool)
        cases[f"w{i}"] = (ref, seqs, arcs, {n: f"s{n}" for n in seqs if n not in inner})
    index = spr.index_dag(g.build(spark, cases))
    for threshold in (-1, 0):
        found = spr.find_moves(index, 6, threshold).collect()
        got = {(r["dag_id"], r["src"], r["dst"]): r["score"] for r in found}
        every = {(k, s, d): v for k, gr in cases.items() for (s, d), v in brute_moves(gr, 6).items()}
        assert got and got == {m: v for m, v in every.items() if v <= threshold}


def test_walk_over_bifurcating_trees(spark, monkeypatch):
    rng = random.Random(3)
    cases = {}
    for i in range(5):
        ref = "".join(rng.choice("ACGT") for _ in range(20))
        seqs, arcs, tips, n = {1: ref}, [(0, 1, 0, 0.0)], [1], 1
        while n < 18 + i:
            p = tips.pop(rng.randrange(len(tips)))
            for clade in range(1 if rng.random() < 0.15 else 2):  # some nodes have a single child
                n += 1
                arcs.append((p, n, clade, 0.0))
                seqs[n] = ref
                tips.append(n)
        for n in tips:
            seqs[n] = "".join(b if rng.random() < 0.6 else rng.choice("ACGT") for b in ref)
        cases[f"b{i}"] = (ref, seqs, arcs, {n: f"s{n}" for n in tips})
    index = spr.index_dag(g.build(spark, cases))
    monkeypatch.setattr(spr, "score_moves", None)  # nothing is replayed
    for radius, threshold in ((1, -1), (2, -1), (4, 1), (8, -1)):
        found = spr.find_moves(index, radius, threshold)
        rows = found.collect()
        got = {(r["dag_id"], r["src"], r["dst"]): r["score"] for r in rows}
        every = {(k, s, d): v for k, gr in cases.items() for (s, d), v in brute_moves(gr, radius).items()}
        assert len(rows) == len(got) and got == {m: v for m, v in every.items() if v <= threshold}
        assert bool(got) == (radius > 1)
    lca = {(r["dag_id"], r["src"], r["dst"]): r["lca"] for r in rows}
    want = {(r["dag_id"], r["src"], r["dst"]): r["lca"] for r in spr.candidate_moves(index, 8).collect()}
    assert all(want[m] == a for m, a in lca.items())


def test_applied_moves_cost_what_was_predicted(forest):
    cases, dag, index = forest
    found = spr.find_moves(index, 4).withColumn(
        "move_id", F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
    )
    out = spr.apply_moves(dag, found)
    again = spr.index_dag(out)
    ua = fitch.sets_up  # noqa: F841
    new = {r["dag_id"]: r["cost"] for r in spr.tree_cost(again).collect()}
    old = {r["dag_id"]: r["cost"] for r in spr.tree_cost(index).collect()}
    root_edge = {r["dag_id"]: r["n"] for r in out.edges.join(
        out.nodes.where("kind = 'ua'").select("dag_id", F.col("node_id").alias("parent_id")),
        ["dag_id", "parent_id"]).groupBy("dag_id").agg(F.sum(F.size("mutations")).alias("n")).collect()}
    rows = found.collect()
    assert rows
    for r in rows:
        ref, seqs, arcs, _ = cases[r["dag_id"]]
        kids = {}
        for p, c, _, _ in arcs:
            if p:
                kids.setdefault(p, []).append(c)
        base = cost_of(ref, seqs, kids, next(c for p, c, _, _ in arcs if p == 0))
        name = f"{r['dag_id']}#{r['move_id']}"
        assert new.get(name, 0) + root_edge[name] == base + r["score"]
    assert old
