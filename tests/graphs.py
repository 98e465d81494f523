"""Small graphs and plain-Python brute force used as ground truth."""

from __future__ import annotations

import itertools
import random

from cladeloom.runtime import cut
from cladeloom.schema import HistoryDag, REFS, edge_schema, node_schema


def diff(seq, ref):
    return [(i + 1, b) for i, (b, r) in enumerate(zip(seq, ref)) if b != r]


def cg_text(seq, ref):
    return "<" + "".join(f"{p}{b}," for p, b in diff(seq, ref)) + ">"


def muts(par, child):
    return [(i + 1, p, c) for i, (p, c) in enumerate(zip(par, child)) if p != c]


def build(spark, graphs):
    """graphs: dag_id -> (ref, {node: seq}, [(parent, child, clade, weight)], {leaf: name})."""
    nodes, edges, refs = [], [], []
    for dag_id, (ref, seqs, arcs, names) in graphs.items():
        refs.append((dag_id, "ref", ref))
        parents = {a[0] for a in arcs}
        nodes.append((dag_id, 0, "ua", None, []))
        for n, seq in seqs.items():
            leaf = n not in parents
            sample = (names or {}).get(n, cg_text(seq, ref)) if leaf else None
            nodes.append((dag_id, n, "leaf" if leaf else "inner", sample, diff(seq, ref)))
        for i, (p, c, clade, w) in enumerate(arcs):
            edges.append(
                (dag_id, i, p, c, clade, muts(ref if p == 0 else seqs[p], seqs[c]), float(w))
            )
    return HistoryDag(
        cut(spark.createDataFrame(nodes, node_schema()).coalesce(1)),
        cut(spark.createDataFrame(edges, edge_schema()).coalesce(1)),
        cut(spark.createDataFrame(refs, REFS).coalesce(1)),
    )


def arcs(text, weights=None):
    """'0>10.0 10>8.0' -> [(0,10,0,w), ...]"""
    out = []
    for i, part in enumerate(text.split()):
        p, rest = part.split(">")
        c, k = rest.split(".")
        out.append((int(p), int(c), int(k), weights[i] if weights else 0))
    return out


# Published toy trees with known distances.
SIX_A = (
    "GAA",
    {1: "ACC", 2: "GTT", 3: "AGG", 4: "ACG", 5: "CTT", 6: "TCC", 7: "TGG", 8: "CTC", 9: "AGT", 10: "GAA"},
    arcs("0>10.0 10>8.0 10>9.1 8>3.0 8>4.1 8>7.2 7>1.0 7>2.1 9>5.0 9>6.1"),
    None,
)
SIX_B = (
    "GAA",
    {1: "TCC", 2: "ACG", 3: "GTT", 4: "AGG", 5: "ACC", 6: "CTT", 7: "AAA", 8: "AAA", 9: "AAA", 10: "GAA"},
    arcs("0>10.0 10>3.0 10>8.1 10>9.2 8>1.0 8>2.1 9>6.0 9>7.1 7>4.0 7>5.1"),
    None,
)
SIX_C = (
    "GAA",
    {1: "ACC", 2: "GTT", 3: "AGG", 4: "ACG", 5: "CTT", 6: "TCC", 7: "TGG", 8: "CTC", 9: "AGT", 10: "GGA", 11: "GAA"},
    arcs("0>11.0 11>10.0 11>9.1 10>8.0 10>7.1 8>3.0 8>4.1 7>1.0 7>2.1 9>5.0 9>6.1"),
    None,
)
WEIGHTED = (
    "AAAA",
    {1: "AAAA", 2: "CAAA", 3: "ACAA", 4: "CCAA", 5: "CACA"},
    arcs("0>1.0 1>2.0 1>3.0 2>4.0 2>5.1 3>4.0 3>5.1", [0.5, 1, 10, 1, 1, 10, 10]),
    None,
)
TIED = ("AAAA", {1: "AAAA", 2: "CAAA", 3: "ACAA"}, arcs("0>1.0 1>2.0 1>3.0", [0.5, 1, 1]), {2: "L", 3: "L"})
MOVES = (
    "AAAA",
    {1: "TAAA", 2: "TAGA", 3: "TAAG", 4: "ACAA", 5: "ACGA", 6: "ACAG",
     7: "AAAA", 8: "AAAA", 9: "AAAA", 10: "TAAA", 11: "ACAA"},
    arcs("0>7.0 7>8.0 7>9.1 8>10.0 8>4.1 10>1.0 10>2.1 9>3.0 9>11.1 11>5.0 11>6.1"),
    None,
)


def random_dag(rng, n_leaves=5, n_sites=4):
    """A random consistent history DAG: for every leaf subset, up to two splits."""
    ref = "".join(rng.choice("ACGT") for _ in range(n_sites))
    seqs, out, ids = {}, [], itertools.count(1)
    memo = {}

    def seq():
        return "".join(rng.choice("ACGT") if rng.random() < 0.5 else r for r in ref)

    leaf_ids = []
    for _ in range(n_leaves):
        n = next(ids)
        seqs[n] = seq()
        leaf_ids.append(n)

    def grow(block):
        block = tuple(sorted(block))
        if len(block) == 1:
            return [block[0]]
        if block in memo:
            return memo[block]
        made = []
        for _ in range(rng.choice([1, 1, 2])):
            node = next(ids)
            seqs[node] = seq()
            parts = rng.choice([2, 2, 3]) if len(block) > 2 else 2
            shuffled = list(block)
            rng.shuffle(shuffled)
            cuts = sorted(rng.sample(range(1, len(block)), parts - 1))
            groups = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(block)])]
            for k, g in enumerate(groups):
                for child in grow(g):
                    out.append((node, child, k, rng.randint(0, 4)))
            made.append(node)
        memo[block] = made
        return made

    for r in grow(leaf_ids):
        out.append((0, r, 0, rng.randint(0, 4)))
    names = {n: f"s{n}" for n in leaf_ids}
    return (ref, seqs, out, names)


def trees_of(arcs_, root=0):
    """All trees as lists of arc indices."""
    kids = {}
    for i, (p, _, k, _) in enumerate(arcs_):
        kids.setdefault(p, {}).setdefault(k, []).append(i)

    def grow(node):
        if node not in kids:
            return [[]]
        per_clade = []
        for alts in kids[node].values():
            per_clade.append([[i, *rest] for i in alts for rest in grow(arcs_[i][1])])
        return [sum(combo, []) for combo in itertools.product(*per_clade)]

    return grow(root)


def edge_cost(graph, i):
    ref, seqs, arcs_, _ = graph
    p, c, _, _ = arcs_[i]
    return len(muts(ref if p == 0 else seqs[p], seqs[c]))
