"""Conversation repair against a plain search over all edit scripts, and edge rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import types as T

from cladeloom.llm import conversation_repair as cr
from cladeloom.llm import queries

GRAMMAR = re.compile(r"(s?(ua)+)?")
TALKS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("seg", T.StringType()), T.StructField("signature", T.LongType()),
])


def plain_repair(rows):
    """(cost, audit, lines) from (role, text, fault) by all scripts with up to three insertions in a row."""

    def scripts(i, inserts):
        if i == len(rows):
            yield 0, "", ()
        else:
            role, text, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            for c, a, out in scripts(i + 1, 0):
                yield c + 2, "D" + a, out
                if fault in ("", "truncated"):
                    yield c + more, "K" + a, ((role, text), *out)
                    for r in ("user", "assistant"):
                        yield c + more + 1, "R" + a, ((r, text), *out)
        if inserts < 2:
            for c, a, out in scripts(i, inserts + 1):
                for r in ("user", "assistant"):
                    yield c + 5, "I" + a, ((r, ""), *out)

    return min((c, a, out) for c, a, out in scripts(0, 0) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)))


def test_audits_against_all_scripts():
    rng, made = random.Random(2), cr.Automaton()
    cases = []
    for _ in range(250):
        rows = []
        for _ in range(rng.randint(0, 3)):
            role = rng.choice(["system", "user", "assistant", "tool", "user", "assistant"])
            rows.append((role, "x", rng.choice(["", "", "truncated", "blank"])))
        cases.append(rows)
    letter = lambda r, f: "d" if f == "blank" else (s := r[0] if r[0] in "sua" else "x").upper() if f else (r[0] if r[0] in "sua" else "x")  # noqa: E731, F841
    for rows in sorted(cases, key=lambda rows: "".join(letter(r, f) for r, _, f in rows)[::-1]):
        assert made.add("".join(letter(r, f) for r, _, f in rows)) == plain_repair(rows)[:2], rows


def plain_query(rows):
    """The query's rows by plain Python: costs by recursion on suffixes with whole audits."""
    groups = {}
    for c, t, r, x, *_ in rows:
        own = groups.setdefault(c, [])
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            own += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = {}
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for t, r, x in own:
            end = x.strip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))

        @cache
        def best(i, state, inserts):
            options = []
            if i == len(own):
                if state in "na":
                    options.append((0, "", ()))
            else:
                _, r, x = own[i]
                more = 5 if faults[i] == "truncated" else 0
                d = best(i + 1, state, 0)
                options.append((d[0] + 2, "D" + d[1], d[2]))
                if faults[i] in ("", "truncated"):
                    for cost, letter, role in ((0, "K", r), (1, "R", "user"), (1, "R", "assistant")):
                        if state + role[:1] in ("nu", "su", "au", "ua") or state == "n" and letter == "K" and role[:1] == "s":
                            n = best(i + 1, role[0], 0)
                            options.append((n[0] + cost + more, letter + n[1], (f"{role}:{x}", *n[2])))
            if inserts < 2:
                role = "assistant" if state == "u" else "user"
                n = best(i, role[0], inserts + 1)
                options.append((n[0] + 5, "I" + n[1], (f"{role}:", *n[2])))
            return min(options) if options else (10**9, "", ())

        cost, audit, lines = best(0, "n", 0)
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 7) for r in rows], TALKS)


def test_query_with_edge_rows(spark, talks, stored):
    rng, rows = random.Random(4), []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["", " \n", None, "Yes.", "No", "What? ", "Fine!\v", "Ü.", f"{t}."])
            rows.append((c, None if rng.random() < 0.1 else t * rng.choice([1, 1, 3]), role, text))
    rows += [(7, 3, "user", "Yes.")] * 3 + [(100, None, None, None), (101, 5, "user", "a long text " * 200000 + ".")]
    rows += [(102, t, "user" if t % 2 else "assistant", f"{t % 700}.") for t in range(300)]
    rng.shuffle(rows)
    got = queries.op13_conversation_repair(spark, stored(talks(rows), "conversations")).collect()
    want = plain_query(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert queries.op13_conversation_repair(spark, stored(talks([]), "conversations")).count() == 0


def test_a_conversation_over_many_segments(spark, talks):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t % 2500}.") for t in range(6000)]
    got = cr.repair(talks(rows)).first()
    assert (got.duplicate, got.illegal, got.gaps, got.truncated) == (3500, 0, 0, 0)
    assert got.audit == "D" + "K" * 2498 + "D" * 3501 or got.audit.count("K") == 2498
    kept = [f"{r}:{x}" for (_, _, r, x), e in zip(rows, got.audit) if e == "K"]
    assert got.cost == 2 * got.audit.count("D") and got.repaired_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
