"""Phrase mining: lossless filters, and the query against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cladeloom.llm import collocations as co
from cladeloom.llm import queries


@pytest.mark.parametrize("n,bits", [(2, 3), (2, 20), (3, 11), (4, 16), (4, 30), (3, 32)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * bits)
    h, l = co._halves(n, bits)
    merged, want, s = {}, Counter(), min(h, 3)
    for _ in range(4):
        ids = rng.integers(1, min(1 << bits, 40), (3000, n))
        ids[::7] = rng.integers(1, 1 << bits, (len(ids[::7]), n))
        want.update(map(tuple, ids.tolist()))
        hi, lo = co.pack(ids, n, bits)
        assert (co.unpack(hi, lo, n, bits) == ids).all()
        hi, lo, counts = co.counted(*co.permute(hi, lo, n, bits), None, l)
        shard = (hi >> np.uint64(h - s)).astype(int)
        for k in set(shard.tolist()):
            own = shard == k
            data = co.QuotientFilter(hi[own], lo[own], counts[own]).dump(h, l, s)
            merged.setdefault(k, []).append(co.QuotientFilter.load(data, h, l, k, s))
    got = Counter()
    for filters in merged.values():
        f = co.QuotientFilter.merged(filters, l)
        ids = co.unpack(*co.permute(f.hi, f.lo, n, bits, back=True), n, bits)
        got.update(dict(zip(map(tuple, ids.tolist()), f.counts.tolist())))
    assert got == want


def test_large_counts_are_listed():
    one = np.array([5], dtype=np.uint64)
    data = co.QuotientFilter(one, one, np.array([10**12])).dump(8, 8, 2)
    assert co.QuotientFilter.load(data, 8, 8, 0, 2).counts.tolist() == [10**12]


def plain(rows):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, 5):
                counts.setdefault(lang or "und", Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= 30}
        gone = {s for p, a in found.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * a >= 80 * c[s := p[i : i + n]]}
        best = []
        for p, a in found.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def test_query_against_plain_counting(spark, documents, stored):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["é", "A", "B", "x y", "\x00"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ", ", ".\n", "\v"]) for _ in range(rng.choice([0, 3, 60, 400])))
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    rows += [(None, None, "en"), (None, "", "xx"), (7, "a b c d " * 40, "de"), (7, "a b c d " * 40, "de"), (8, "p q r " * 60000, "en")]
    got = queries.op12_phrase_collocations(spark, stored(documents(rows)))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == plain(rows)
    assert queries.op12_phrase_collocations(spark, stored(documents([]))).count() == 0
