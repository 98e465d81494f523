"""The near-dedup stage against all pairs' five-word similarity."""

import random
from collections import Counter

import corpus_pipeline as pipeline


def plain_kept(rows):
    """Ids that stay, from all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_copies_with_changed_words(spark, documents):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), *(" ".join(edited(rng, base, n)) for n in (1, 2, 4, 6, 12))]
    for _ in range(3):  # chains whose ends are not similar
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(6):
            texts.append(" ".join(words))
            words = edited(rng, words, 3)
    texts += ["a b c", "A  b c", "a b d", "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(rows), "").collect()}
    assert got == plain_kept(rows)


def test_a_hot_group_of_near_copies(spark, documents):
    """Copies around one base, at all distances, with and without unrelated words."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(0, 9))) for _ in range(300)))
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(rows), "").collect()}
    assert got == plain_kept(rows)


def test_the_given_documents(spark):
    """All pairs that share a five-word shingle, on the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter(plain_kept([(r.doc_id, r.text) for r in docs.collect()]))
