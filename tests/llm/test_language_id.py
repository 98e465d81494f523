"""Language ID: the model against its formulas, held-out accuracy, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cladeloom.llm import language_id, queries


def plain_kneser_ney(texts):
    """p(gram) of all orders, straight from the definition."""
    counts = {4: Counter()}
    for t in texts:
        s = "\0\0\0" + t
        counts[4].update(s[i : i + 4] for i in range(len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, types = {}, defaultdict(int), defaultdict(int)
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
        for g, v in c.items():
            total[n, g[:-1]] += v
            types[n, g[:-1]] += 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        low = p(g[1:])
        if not total[n, g[:-1]]:
            return low
        return (max(counts[n][g] - discount[n], 0) + discount[n] * types[n, g[:-1]] * low) / total[n, g[:-1]]

    return p, counts[4]


def test_model_follows_the_formulas():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé \U0001d49c") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    p, counts = plain_kneser_ney(texts)
    keys = np.concatenate([k for k, _ in language_id.grams(texts)])
    model = language_id.kneser_ney(*np.unique(keys, return_counts=True))
    tests = [*counts, "zzzz", "abz" + "a", "\0\0\0a", "cabz"]
    packed = {g: np.concatenate([k for k, _ in language_id.grams(["xyz" + g])]) for g in tests if "\0" not in g}
    for g, k in packed.items():
        assert math.isclose(math.exp(model.log_p(k[-1:])[0]), p(g), rel_tol=1e-9), g
    for context in ("abc", "a b", "zzz"):  # a distribution, with one more character for all unseen ones
        assert math.isclose(sum(p(context + c) for c in "abcé \U0001d49cz"), 1, rel_tol=1e-9)


def test_long_texts_in_chunks(monkeypatch):
    text = "".join(random.Random(2).choice("abcde ") for _ in range(1000))
    whole = Counter(np.concatenate([k for k, _ in language_id.grams([text, "b", text])]).tolist())
    monkeypatch.setattr(language_id, "CHUNK", 64)
    parts = list(language_id.grams([text, "b", text]))
    assert Counter(np.concatenate([k for k, _ in parts]).tolist()) == whole
    assert Counter(np.concatenate([o for _, o in parts]).tolist()) == {0: 1000, 1: 1, 2: 1000}


def test_query_learns_from_the_rest_only(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [i for i, r in got.items() if r.held_out and docs[i].lang and r.lang_pred != "und"]
    assert sum(got[i].lang_pred == docs[i].lang for i in out) >= 0.97 * len(out) > 100
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.accepted for r in got.values()) >= 0.99 * len(got)


def test_edges_and_rejection(documents):
    rng = random.Random(3)
    a = lambda n: " ".join(rng.choice(["the", "then", "other", "weather"]) for _ in range(n))
    b = lambda n: " ".join(rng.choice(["que", "queso", "otro", "año"]) for _ in range(n))
    rows = [(i, a(40), "en", "s") for i in range(60)] + [(100 + i, b(40), "es", "s") for i in range(60)]
    odd = [
        (None, None, None), (300, "", "en"), (301, "123 ... ²", "es"), (302, "x", None), (302, "x", None), (303, a(40000), None),
        (304, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(900)), None),
    ]
    got = [(r.doc_id, r.language) for r in language_id.identify(documents(rows + odd)).collect()]
    assert len(got) == len(rows + odd)
    at = defaultdict(list)
    for i, r in got:
        at[i].append(r)
    for i in (None, 300, 301):
        assert [(r.lang_pred, r.score, r.accepted) for r in at[i]] == [("und", 0.0, False)]
    assert len(at[302]) == 2 and at[302][0] == at[302][1] and at[302][0].lang_pred in ("en", "es")
    assert at[303][0].lang_pred == "en" and at[303][0].accepted
    assert not at[304][0].accepted
    assert all(at[i][0].lang_pred == lang and at[i][0].accepted for i, _, lang, _ in rows)
    unlabelled = language_id.identify(documents([(1, "some text")])).collect()
    assert [(r.language.lang_pred, r.language.accepted) for r in unlabelled] == [("und", False)]
    assert language_id.identify(documents([])).count() == 0


def two_languages(rng):
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    return [(i, text("etaoinshr"), "en") for i in range(30)] + [(50 + i, text("aeosñílrc"), "es") for i in range(30)]


def test_large_models_are_scored_by_shards(documents, monkeypatch):
    rows = [*two_languages(random.Random(5)), (None, None, "en"), (90, "", None), (91, "x", None), (91, "x", None), (92, "the \U0001d49c 字" * 99, None)]
    df = documents(rows).withColumn("language", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("sums", F.lit("x"))
    whole = sorted(language_id.identify(df).collect(), key=str)
    monkeypatch.setattr(language_id, "SHARD_GRAMS", 700)
    made, models = language_id.fit(documents(rows).select("doc_id", "lang", "text"))
    shards = list(models)
    assert models.shards == len(shards) > 3 and made.langs == ["en", "es"]
    keys = np.concatenate([k for k, _ in language_id.grams([language_id.letters(r[1]) for r in rows if r[2]])])
    assert sum(len(s.models[0].orders[3][0]) + len(s.models[1].orders[3][0]) for s in shards) >= len(np.unique(keys))
    parts = sorted(language_id.identify(df).collect(), key=str)
    assert len(parts) == len(whole) == len(rows)
    for a, b in zip(whole, parts):
        assert (a.doc_id, a.text, a.row, a.sums, a.language.lang_pred, a.language.accepted) == (b.doc_id, b.text, b.row, b.sums, b.language.lang_pred, b.language.accepted)
        assert math.isclose(a.language.score, b.language.score, rel_tol=1e-9)


def test_predictions_of_a_plain_model(documents):
    rows = two_languages(random.Random(6))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    plain = {x: plain_kneser_ney([language_id.letters(t) for _, t, lang in learned if lang == x])[0] for x in ("en", "es")}
    for r in language_id.identify(documents([*rows, (99, "Sería: EL 7 tren", None)])).collect():
        s = "\0\0\0" + language_id.letters(r.text)
        ce = {x: -sum(math.log(p(s[i : i + 4])) for i in range(len(s) - 3)) / (len(s) - 3) for x, p in plain.items()}
        assert r.language.lang_pred == min(ce, key=ce.get)
        assert math.isclose(r.language.cross_entropy, min(ce.values()), rel_tol=1e-9)


def test_calibration_rows_are_scored_by_models_without_them(documents, monkeypatch):
    rows, seen = two_languages(random.Random(7)), []
    monkeypatch.setattr(language_id.Identifier, "calibrate", lambda self, ce, n, truth: seen.append((ce, n, truth)))
    language_id.fit(documents(rows).select("doc_id", "lang", "text"))
    out = {i for i, *_ in rows if zlib.crc32(hashlib.md5(str(i).encode()).hexdigest().encode()) % language_id.APART == 0}
    want = []
    for x, name in enumerate(("en", "es")):
        p, _ = plain_kneser_ney([language_id.letters(t) for i, t, lang in rows if lang == name and i not in out])
        for i, t, lang in rows:
            if i in out and lang == name:
                s = "\0\0\0" + language_id.letters(t)
                want.append(-sum(math.log(p(s[k : k + 4])) for k in range(len(s) - 3)) / (len(s) - 3))
    ce, n, truth = seen[0]
    assert len(truth) == len(out) and np.allclose(sorted(ce[range(len(truth)), truth]), sorted(want))
