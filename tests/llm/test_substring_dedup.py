"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

import numpy as np

from cladeloom.llm import bytehash, queries, substring_dedup


def brute(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - 49):
                key = tuple(w[p : p + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def compare(got, rows):
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)


def test_passages(documents, stored, spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(3000)]
    line = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [line(n) for n in (49, 50, 51, 130, 700)]
    rows = [(None, None), (None, " ".join(shared[3])), (0, ""), (1, "\t\n"), (2, "short text"), (3, "short text")]
    ids = rng.sample(range(10, 2000), 150)
    for i in ids:
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += line(rng.randint(0, 150))
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += p[a : a + rng.randint(40, len(p))]
            if rng.random() < 0.2:
                parts += p * 2
        rows.append((i, rng.choice([" ", "\n", " \x0b"]).join(parts)))
    base = line(400)
    for i in range(3000, 3030):  # near and exact copies, repeated rows, one id with two texts
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(400)] = "edit"
        rows.append((i, " ".join(near)))
    rows += [rows[-1], (3000, " ".join(base[100:300] + line(60))), (3500, "same " * 900), (3501, "same " * 901), (3502, "a b " * 300)]
    rows += [(3503, "x a b " + "a b " * 200), (3504, "u v " * 120), (3505, "u v " * 100)]
    df = documents(rows)
    compare(queries.op8_substring_dedup(spark, stored(df)).collect(), rows)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 2000)
    left, changed = substring_dedup.repeated_passages(df)
    compare(left.collect(), rows)
    kept = {r.kept_sha256 for r in left.collect()}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() in kept for r in changed.collect())


def test_a_single_window_and_empty_tables(documents):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(5, "a " + text + " b"), (4, text), (9, text + " tail"), (7, " ".join(f"t{i}" for i in range(49)))]
    compare(substring_dedup.repeated_passages(documents(rows))[0].collect(), rows)
    assert substring_dedup.repeated_passages(documents([]))[0].count() == 0


def test_bytes_of_words(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "\x0ba\t\n b\x1c\u00a0c \x0c", "é ü" * 5] + [
        "".join(rng.choice("ab é\t\n") for _ in range(rng.randint(1, 300))) for _ in range(200)
    ]
    seen = {}
    for segment in (1 << 20, 40):
        monkeypatch.setattr(bytehash, "SEGMENT", segment)
        hasher = bytehash.ByteHasher()
        for t in texts:
            data, starts, ends = bytehash.split(t)
            words = t.encode().split()
            assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == words
            assert bytehash.joined(data, starts, ends) == b" ".join(words)
            keep = np.array([rng.random() < 0.5 for _ in words], dtype=bool)
            assert bytehash.joined(data, starts, ends, keep) == b" ".join(w for w, k in zip(words, keep) if k)
            h = hasher.words(data, starts, ends)
            for w, x in zip(words, h.tolist()):
                assert seen.setdefault(w, x) == x
            for p, x in enumerate(hasher.runs(h, 3).tolist()):
                assert seen.setdefault(tuple(words[p : p + 3]), x) == x
    assert len(set(seen.values())) == len(seen)
