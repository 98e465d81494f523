"""Bitmap leaf sets against the listed (node, leaf) pairs, over many chunks."""

import random
from collections import defaultdict

from cladeloom.operators import leafsets, trim
from tests import graphs as g


def named(arcs):
    nodes = {a[1] for a in arcs}
    return ("A", {n: "A" for n in nodes}, arcs, {n: f"L{n}" for n in nodes})


def random_dag(rng, leaves):
    """Arcs of a DAG of three inner levels whose clades' alternatives differ in leaves."""
    top, mid = range(1, 5), range(10, 34)
    arcs = [(0, t, 0, 0) for t in top]
    arcs += [(t, m, c, 0) for t in top for c in range(3) for m in rng.sample(mid, 2)]
    arcs += [(m, 100 + x, x % 7, 0) for m in sorted({a[1] for a in arcs if a[0]}) for x in rng.sample(range(leaves), leaves // 2)]
    return named(arcs)


def test_bitmaps_hold_the_closure(spark, monkeypatch):
    monkeypatch.setattr(leafsets, "NUMBERED", 100)
    rng = random.Random(4)
    dag = g.build(spark, {"a": random_dag(rng, 400), "b": random_dag(rng, 30)})
    bits = leafsets.leaf_bits(leafsets.levels_with_bits(dag))
    listed = leafsets.leaf_closure(leafsets.levels_with_leaves(dag))
    place = {}
    for r in bits.levels.ranked.where("leaf_name is not null").select("dag_id", "leaf_name", "leaf_chunk", "leaf_bit").distinct().collect():
        key = (r.dag_id, tuple(r.leaf_chunk), r.leaf_bit)
        assert key not in place and r.leaf_bit > 0
        place[key] = r.leaf_name
    assert len({k[1] for k in place}) > 6
    for got, want, by in ((bits.nodes, listed.nodes, ["dag_id", "node_id"]), (bits.clades, listed.clades, ["dag_id", "parent_id", "clade_index"])):
        have, need = defaultdict(set), defaultdict(set)
        for r in got.collect():
            have[tuple(r[c] for c in by)] |= {place[r.dag_id, tuple(r.chunk), 1 << i] for i in range(63) if r.bits >> i & 1}
        for r in want.collect():
            need[tuple(r[c] for c in by)].add(r.leaf)
        assert have == need


def test_trimming_many_leaves(spark):
    """Of two alternatives the one that lacks some of 200 leaves goes, also where a third level follows."""
    arcs = [(0, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 0)] + [(2, 100 + x, x, 0) for x in range(200)] + [(3, 100 + x, x, 0) for x in range(0, 200, 3)]
    dag = g.build(spark, {"t": named(arcs)})
    out, report = trim.trim_inconsistent(dag)
    assert tuple(report.first())[1:] == (1, 0)
    assert out.edges.count() == 202 and out.nodes.where("node_id = 3").isEmpty()
