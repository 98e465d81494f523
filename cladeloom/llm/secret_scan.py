"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body


def _either(word: str) -> str:
    """ASCII letters in either case, without an engine's own case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: In the order in which spans of equal start are listed.
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Windows of ``window`` characters of one alphabet are hot from ``bits`` of entropy."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float
    #: A candidate that matches none of ``needs``, or any of ``allow``, is suppressed.
    needs: tuple[str, ...]
    allow: tuple[str, ...]


_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Identifiers and words carry no digit; placeholders repeat or count up.
_PLACEHOLDERS = (r"(?i)example|placeholder|changeme|dummy|sample|your[_-]", r"(.)\1{5,}", r"0123456789|abcdefghij|ABCDEFGHIJ")
CLASSES = (
    CharClass(
        "entropy_hex", "0123456789abcdefABCDEF", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{32,}(?![A-Za-z0-9+/_=-])",
        24, 2.9, (r"[A-Fa-f]",), (*_PLACEHOLDERS, r"^[0-9]+$"),
    ),
    CharClass(
        "entropy_base64", "0123456789" + _LOWER + _LOWER.upper() + "+/_=-",
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 20, 3.7, (r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]",),
        (*_PLACEHOLDERS, r"^[0-9A-Fa-f-]+$", r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(_|-|=|/){4,}"),
    ),
)
KINDS = (*BASE, *(c.name for c in CLASSES))
#: Counts times their binary logarithm, as integers in units of 1 / UNIT bits.
UNIT = 1 << 20
#: Matches that are appended together.
CHUNK = 256


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's matches, in code points.

    The pieces between the matches and the matches give the positions; they are
    added up in chunks, so appending stays cheap for texts with many matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(hit_list: Column) -> Column:
        units = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hit_list.alias("hit"))
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(hit_list) - 1) / CHUNK).cast("int")),
            lambda c: F.slice(units, c * CHUNK + 1, F.least(F.lit(CHUNK), F.size(hit_list) - c * CHUNK)),
        )
        one = "array<struct<start:int,end:int,hit:string>>"

        def add(acc, u):
            start = acc["at"] + F.length(u["gap"])
            end = start + F.length(u["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), u["hit"].alias("hit"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).cast(one).alias("spans"))

        def chunk(acc, us):
            done = F.aggregate(us, F.struct(acc["at"].alias("at"), F.array().cast(one).alias("spans")), add)
            return F.transform(
                F.array(done),
                lambda d: F.struct(
                    d["at"].alias("at"), F.concat(acc["spans"], F.array(d["spans"])).cast(f"array<{one}>").alias("spans")
                ),
            )[0]

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("spans"))
        return F.flatten(F.aggregate(chunks, zero, chunk)["spans"])

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, walk(h)).otherwise(none))[0]


def _spans(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def _hot(candidate: Column, of: CharClass) -> Column:
    """Merged hot windows of one candidate, as spans.

    The window's counts per character change by the character that enters and
    the one that leaves, and with them the sum of n log2 n.
    """
    w = of.window
    table = F.array(*[F.lit(round(n * math.log2(n) * UNIT) if n else 0).cast("bigint") for n in range(w + 2)])
    most = F.lit(math.floor(w * (math.log2(w) - of.bits) * UNIT)).cast("bigint")
    kind = KINDS.index(of.name)
    spans = "array<struct<start:int,kind:int,end:int>>"
    marks = F.transform(F.split(candidate["hit"], ""), lambda c: F.instr(F.lit(of.alphabet), c))

    def scan(m: Column) -> Column:
        def put(counts, at, by):
            return F.concat(
                F.slice(counts, F.lit(1), at - 1), F.array(F.element_at(counts, at) + by),
                F.slice(counts, at + 1, F.lit(len(of.alphabet))),
            )

        def weight(counts, at, by):
            n = F.element_at(counts, at)
            return F.element_at(table, n + by + 1) - F.element_at(table, n + 1)

        def step(acc, i):
            new = F.element_at(m, i)
            came = F.struct(
                put(acc["counts"], new, 1).alias("counts"), (acc["sum"] + weight(acc["counts"], new, 1)).alias("sum")
            )

            def leave(c):
                old = F.element_at(m, F.greatest(i - w, F.lit(1)))
                return F.when(i <= w, c).otherwise(
                    F.struct(put(c["counts"], old, -1).alias("counts"), (c["sum"] + weight(c["counts"], old, -1)).alias("sum"))
                )

            def mark(c):
                hot = (i >= w) & (c["sum"] <= most)
                begin = i - w
                joins = hot & (acc["to"] >= begin) & (acc["to"] > 0)
                closed = hot & ~joins & (acc["to"] > 0)
                span = F.struct(
                    (candidate["start"] + acc["from"]).alias("start"), F.lit(kind).alias("kind"),
                    (candidate["start"] + acc["to"]).alias("end"),
                )
                return F.struct(
                    c["counts"].alias("counts"), c["sum"].alias("sum"),
                    F.when(hot & ~joins, begin).otherwise(acc["from"]).alias("from"),
                    F.when(hot, i).otherwise(acc["to"]).alias("to"),
                    F.when(closed, F.concat(acc["done"], F.array(span))).otherwise(acc["done"]).cast(spans).alias("done"),
                )

            left = F.transform(F.array(came), leave)
            return F.transform(left, mark)[0]

        zero = F.struct(
            F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
            F.lit(0).alias("from"), F.lit(0).alias("to"), F.array().cast(spans).alias("done"),
        )

        def finish(acc):
            span = F.struct(
                (candidate["start"] + acc["from"]).alias("start"), F.lit(kind).alias("kind"),
                (candidate["start"] + acc["to"]).alias("end"),
            )
            return F.when(acc["to"] > 0, F.concat(acc["done"], F.array(span)).cast(spans)).otherwise(acc["done"])

        return F.aggregate(F.sequence(F.lit(1), F.size(m)), zero, step, finish)

    return F.transform(F.array(marks), scan)[0]


def _entropy_spans(text: Column, of: CharClass) -> Column:
    def suspect(c):
        test = F.lit(True)
        for p in of.needs:
            test = test & c["hit"].rlike(p)
        for p in of.allow:
            test = test & ~c["hit"].rlike(p)
        return test

    return F.flatten(F.transform(F.filter(_found(text, of.pattern), suspect), lambda c: _hot(c, of)))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans``: array<struct<start, kind, end>>.

    Positions are code points of the whole text, ends exclusive, ``kind`` an
    index into KINDS.  Base patterns match leftmost without overlap; assigned
    values of fewer than six characters are dropped after matching.  Entropy
    spans are the merged windows of a candidate whose Shannon entropy reaches
    the bound of its character class; candidates that look like identifiers,
    placeholders, numbers or UUIDs are suppressed.  Both arrays are sorted.

    All of it works on a row alone: nothing is shuffled, and rows that repeat
    give equal results.  A null text is empty; an empty text has no spans.
    Columns of these names in ``docs`` are replaced, all others stay.
    """
    text = body(text_col)
    value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= LEAST_VALUE
    base = F.concat(
        _spans(F.filter(_found(text, ASSIGN), value), "assign"),
        _spans(_found(text, ACCESS), "access"),
        _spans(_found(text, HEX), "hex"),
    )
    hot = F.concat(*[_entropy_spans(text, c) for c in CLASSES])
    return docs.withColumns({"base_spans": F.array_sort(base), "entropy_spans": F.array_sort(hot)})
