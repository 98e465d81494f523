"""SimHash fingerprints, exact pairs and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from cladeloom.llm import queries, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, reach):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= reach:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def planted(rng, n, clusters):
    out = {rng.getrandbits(64) for _ in range(n)}
    for size, bits in clusters:
        seed = rng.getrandbits(64)
        for _ in range(size):
            x = seed
            for b in rng.sample(range(64), rng.randint(0, bits)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def check_links(values, reach):
    got = {v: {v} for v in values}
    pairs = [p for a, b in simhash.links(np.array(values, dtype=np.uint64), reach) for p in zip(a.tolist(), b.tolist())]
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == plain_components(values, reach), len(got)


def test_links_in_a_task():
    rng = random.Random(1)
    check_links(planted(rng, 1500, [(300, 3), (200, 8), (50, 1)]), 2)
    check_links(planted(rng, 300, [(900, 2)]), 1)
    check_links([0], 2)


def test_links_of_dense_leaves_by_lookup(monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE", 100)
    check_links(planted(random.Random(2), 50, [(700, 2)]), 2)


def test_every_close_pair_meets_in_a_shard():
    rng = random.Random(3)
    values = np.array(planted(rng, 1500, [(300, 4), (200, 9)]), dtype=np.uint64)
    tree = simhash.grow(values[::3], 5, 2)
    met = defaultdict(set)
    for shard, mine in simhash.route(values, tree, 2):
        for v in mine.tolist():
            met[v].add(shard)
    assert len({s for x in met.values() for s in x}) > 4
    for i, a in enumerate(values.tolist()):
        close = values[:i][np.bitwise_count(values[:i] ^ np.uint64(a)) <= 2]
        assert all(met[a] & met[b] for b in close.tolist())


def test_near_groups(documents, stored, spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, None), (50, ""), (51, " \t"), (7, "One"), (8, "one"), (8, "one"), (9, "one two"), (10, "É two")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 60, 600]))]
        rows.append((100 + 10 * i, " ".join(base)))
        for j in range(rng.randint(0, 5)):
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((101 + 10 * i + j, " \n".join(base).upper() if j % 2 else " ".join(base)))
    rows.append((5000, "long " * 200000))
    got = queries.op7_simhash_groups(spark, stored(documents(rows))).collect()
    fps = [plain_fingerprint(t) for _, t in rows[:-1]] + [plain_fingerprint("long " * 9)]
    roots = plain_components(fps, 2)
    ids = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        ids[roots[f]].append(i)
    want = [(str(i), f"{f:016x}", min(x for x in ids[roots[f]] if x is not None)) for (i, _), f in zip(rows, fps)]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(want)
    assert simhash.near_groups(documents([])).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(200, 260)] + [(x, x + 500) for x in range(200, 230)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    got = dict(map(tuple, simhash.components(df).collect()))
    assert got == {**{x: 100 for x in range(100, 161)}, 1: 1, **{x: 1 for x in range(200, 260)}, **{x: 1 for x in range(700, 730)}}
