"""HyperMinHash near-dedup: registers, estimates, the query against all pairs."""

import random

import numpy as np
from test_near_dedup import edited

from cladeloom.llm import hyperminhash as hmh
from cladeloom.llm import queries
from cladeloom.llm.bytehash import ByteHasher


def plain(rows, k=3, percent=85):
    """(doc_id, n, component, kept) from all pairs; ids are distinct."""
    sets = {i: hmh.shingles(t or "", k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_registers_hold_leading_zeros_and_mantissa():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    got = hmh.registers(h)
    short = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(got), 17):
        x = [(int(v) ^ int(hmh._SALT[i, 0])) * int(hmh._MUL[i, 0]) % 2**32 for v in short]
        x = [(v ^ v >> 15) * int(hmh._MUL2[i, 0]) % 2**32 for v in x]
        low = min(v ^ v >> 16 for v in x)
        bits = low.bit_length()
        mantissa = (low >> max(0, bits - 11)) & 1023
        assert got[i] == (32 - bits) << 10 | mantissa
    assert (hmh.registers(np.concatenate([h, h[:200]])) == got).all()


def test_estimates_are_corrected_and_close():
    rng = np.random.default_rng(2)
    for n, shared in ((400, 370), (400, 200), (60, 50), (20000, 18000), (300, 0)):
        errors = []
        for _ in range(12):
            h = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            equal = (hmh.registers(h[:n]) == hmh.registers(h[n - shared :])).sum()
            errors.append(hmh.corrected(np.array([equal]), np.array([n]), np.array([n]))[0] - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.04, (n, shared, errors)
    assert hmh.corrected(np.array([0]), np.array([5]), np.array([900]))[0] == 0


def test_pairs_at_the_threshold_share_a_band():
    rng, hasher, pairs = random.Random(4), ByteHasher(), 0
    while pairs < 300:
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts = [" ".join(base), " ".join(edited(rng, base, 5))]
        a, b = (hmh.shingles(t) for t in texts)
        if 0.85 <= len(a & b) / len(a | b) < 0.87:
            pairs += 1
            x, y = (hmh.registers(hmh.shingle_hashes(t, 3, hasher)[0]).reshape(hmh.BANDS, -1) for t in texts)
            assert (x == y).all(axis=1).any()


def test_query_against_all_pairs(spark, documents, stored):
    rng, texts = random.Random(8), []
    for _ in range(30):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 5, 40, 300]))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, min(len(base), n))) for n in (1, 1, 2, 5, 20)]
    hot = [f"h{rng.randrange(9000)}" for _ in range(100)]
    texts += [" ".join(edited(rng, hot, rng.randrange(8))) for _ in range(200)]
    texts += [texts[0].upper(), "  " + texts[0], "One two", "one\ttwo", "one", "one one one one", "", None, " \n", "É b c", "é b c", "long " * 200000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = queries.op11_hyperminhash_groups(spark, stored(documents(rows))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain(rows)


def test_edge_rows(documents):
    rows = [(None, None), (None, "a b c d"), (3, "a b c d"), (3, "A b c d"), (None, "x y z"), (4, ""), (4, "")]
    got = hmh.near_groups(documents(rows))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    assert found == sorted([(None, 0, None, False), (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 1, None, False), (4, 0, 4, True), (4, 0, 4, True)], key=str)
    assert hmh.near_groups(documents([])).count() == 0
