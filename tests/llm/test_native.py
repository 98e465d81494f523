"""Secret scan, mixing, sharding and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib

from cladeloom.llm import exact_dedup, mixing, queries, secret_scan, sharding

EDGE = [(None, None), (1, ""), (2, " "), (3, "a b c\x0bd"), (3, "a b c\x0bd"), (4, "x " * 30000), (5, None), (None, "n n")]


def secrets_of(text):
    text, spans = text or "", []
    keyword = r"(password|passwd|secret|token|api_?key)"
    for kind, pattern, ok in (
        ("assign", keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(spans, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def entropy_of(text, c):
    """Spans of one class, every window counted anew."""
    out = []
    for m in re.finditer(c.pattern, text or ""):
        if not all(re.search(p, m[0]) for p in c.needs) or any(re.search(p, m[0]) for p in c.allow):
            continue
        hot = []
        for i in range(len(m[0]) - c.window + 1):
            w = m[0][i : i + c.window]
            h = -sum(w.count(x) / c.window * math.log2(w.count(x) / c.window) for x in set(w))
            if h >= c.bits - 1e-6:
                a, b = m.start() + i, m.start() + i + c.window
                if hot and a <= hot[-1][1]:
                    hot[-1][1] = b
                else:
                    hot.append([a, b])
        out += [(a, c.name, b) for a, b in hot]
    return out


def test_secret_scan(documents, stored, spark):
    rng = random.Random(5)
    junk = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    b64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
    texts = [t for _, t in EDGE] + [
        "password=abc secret: 'hunter22' Api_Key = \"a.b-c_d\" ſecret=abcdefgh toKen=abcdefgh",
        "secret=token: abcdefgh", "\U0001f600 AKIA" + "Z9" * 9 + " AKIA123 xAKIA" + "A" * 16, "f" * 24 + " " + "0a" * 40,
        " ".join(f"token={junk(rng.randint(3, 9), b64)} {junk(6, 'abcdef0123456789')}" for _ in range(700)),
        "see " + junk(60, b64) + " and aaaa" + junk(30, "abcXYZ019") + "." + "ab1" * 30,
        junk(3000, b64), "E" + junk(63, "0123456789ABCDEF") + " 123e4567-e89b-12d3-a456-426614174000",
        "my_example_" + junk(30, b64), *(junk(40, b64) + "=" + junk(50, "abc1") + junk(40, b64) for _ in range(20)),
    ]
    df = documents([(i, t, None, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, stored(df)).collect()}
    for i, t in enumerate(texts):
        base = secrets_of(t)
        line = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in ("assign", "access", "hex"))
        every = base + [s for c in secret_scan.CLASSES for s in entropy_of(t, c)]
        every.sort(key=lambda s: (s[0], secret_scan.KINDS.index(s[1]), s[2]))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, k, b in every), t
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_exact_groups(documents):
    rows = EDGE + [(9, "same"), (7, "same"), (7, "same"), (8, "Same"), (None, "only"), (None, "only")]
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_dedup.exact_groups(documents(rows), keep).collect()
        assert len(got) == len(rows)
        by = {}
        for i, t in rows:
            by.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
        for key, ids in by.items():
            mine = [r for r in got if r.text_sha256 == key]
            want = best([i for i in ids if i is not None], default=None)
            assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
            assert {(r.keep_id, r.group_size) for r in mine} == {(want, len(ids))}
            assert [r.doc_id for r in mine if r.kept] == [want]
    assert exact_dedup.exact_groups(documents([])).count() == 0


def jump_hash(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / float((key >> 33) + 1)))
    return b


def test_shards(documents):
    rows = EDGE + [(i, f"text {i % 9} é") for i in range(10, 700)]
    df = documents(rows)
    for shards in (1, 7, 40, 3000):
        got = sharding.assign_shards(df, shards, blocks=4).collect()
        assert len(got) == len(rows)
        for r in got:
            key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
            assert (r.shard, r.grown_shard) == (jump_hash(key, shards), jump_hash(key, shards + 1))
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert sharding.assign_shards(documents([])).count() == 0


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 4000, "c": 7, None: 300, "z": 5, "zero": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, want, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(want.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    assert all(math.isclose(got[s].target, want[s], abs_tol=1e-9) for s in sizes)


def test_mix(documents):
    rng = random.Random(3)
    rows = [(i, t, None, "a") for i, t in EDGE]
    rows += [(100 + i, "w " * rng.randint(1, 900), None, rng.choice(["a", "a", "b", "c", None])) for i in range(400)]
    df = documents(rows)
    pieces = mixing.mix(df)
    got = mixing.taken(pieces).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), count(r[1])) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= 0.01 * target + 2
    parts = pieces.where("slot is not null").collect()
    assert sum(p.words for p in parts) == sum(r.taken for r in got)
    assert len({(p.i, p.slot) for p in parts}) == len({p.slot for p in parts})  # a slot has one source
    assert sorted(map(str, mixing.taken(mixing.mix(df.repartition(7))).collect())) == sorted(map(str, got))
    assert mixing.taken(mixing.mix(documents([]))).count() == 0
