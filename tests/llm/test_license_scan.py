"""License scan against every shingle of every window counted in plain Python."""

import random

from cladeloom.llm import license_scan as ls
from cladeloom.llm import queries


def licenses_of(text):
    """License -> best containment, no key words and no bands."""
    w = ls.tokens(text or "")
    sh = [" ".join(w[i : i + ls.SHINGLE]) for i in range(len(w) - ls.SHINGLE + 1)]
    out = {}
    for name, template in ls.TEMPLATES:
        wanted, step = set(ls.shingles(template)), ls.step(template)
        for at in range(0, len(sh), step):
            c = len(wanted & set(sh[at : at + 3 * step])) / len(wanted)
            if c >= ls.CONTAINED:
                out[name] = max(out.get(name, 0), c)
    return out


def check(df, rows):
    want = {}
    for i, t in rows:
        for name, c in licenses_of(t).items():
            want[i, name] = max(want.get((i, name), 0), c)
    got = ls.scan_licenses(df).collect()
    assert {(r.doc_id, r.license): r.containment for r in got} == want and len(got) == len(want)
    return want


def test_every_template_is_found_anywhere(documents):
    rng = random.Random(7)
    noise = lambda n: " ".join(rng.choice("the of work license public terms software a x1 copy".split()) for _ in range(n))
    rows = [(n, f"{noise(rng.randint(0, 90))} {t.upper() if n % 3 else t}, {noise(rng.randint(0, 90))}") for n, (_, t) in enumerate(ls.TEMPLATES)]
    want = check(documents(rows), rows)
    assert all(want.get((n, name)) == 1.0 for n, (name, _) in enumerate(ls.TEMPLATES))


def test_damaged_templates_are_judged_by_their_shingles(documents):
    rng, rows = random.Random(8), []
    for n in range(120):
        words = ls.TEMPLATES[n % len(ls.TEMPLATES)][1].split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((n, "before it " + " ".join(words) + " and after"))
    want = check(documents(rows), rows)
    assert 0 < len({i for i, _ in want}) < len(rows)


def test_edge_rows(documents, stored, spark):
    mit = ls.TEMPLATES[0][1]
    rows = [
        (None, None), (None, mit), (1, ""), (2, " \n"), (3, "MIT License"), (4, mit), (4, mit), (4, "unrelated words only, five of them"),
        (5, "license " * 20000 + mit + " software" * 20000), (6, (mit + " ") * 300), (7, "_".join(mit.split())), (8, "\u00e9 \u4e2d\u6587 " + mit),
    ]
    want = check(documents(rows), rows)
    assert {i for i, _ in want} == {None, 4, 5, 6, 7, 8}
    assert ls.scan_licenses(documents([])).count() == 0
    assert queries.op6_license_scan(spark, stored(documents(rows))).columns == ["doc_id", "license", "containment"]
