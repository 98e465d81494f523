"""Conversation repair: cheapest edits by a suffix-shared automaton of role and fault signatures.

Rows are sorted by ranges of (conversation, turn), so a conversation of any
length is spread over tasks as segments of bounded size.  Each row becomes one
symbol.  The different signatures are read in the order of their ends, and every
common ending is one automaton node with its cost-to-go and its best first edit
for each state of the role grammar.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeloom.llm.common import bound_batches
from cladeloom.runtime import cut

#: Rows and characters of a segment, at most (one longer text is a segment of its own).
ROWS, CHARS = 2048, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = "[^\\x20\\x09-\\x0D]"
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled row leads: always the one role that is legal next.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a kept row of a role's initial leads, by state; other moves are illegal.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}


def damaged(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it,
    4 makes it a user's; nulls read as one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn))) % 20
    rows = talks.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), x.alias("x"))
    return rows.where("x != 0").select(
        "conv_id", "turn",
        F.when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def symbol(role: str, text: str) -> str:
    """d: to be deleted; else the role's initial or x, as a capital if the text is truncated."""
    end = text.rstrip(" \t\n\v\f\r")
    if not end:
        return "d"
    s = role[:1] if role[:1] in KEPT else "x"
    return s if end[-1] in ".!?" else s.upper()


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of a conversation's rows, in order: symbols, first occurrences and illegal neighbours."""
    part, made = TaskContext.get().partitionId() << 32, 0
    last, roles, texts, held = None, [], [], 0

    def segment():
        symbols, seen, fresh = [], set(), []
        for i, (r, t) in enumerate(zip(roles, texts)):
            s = symbol(r, t)
            digest = xxhash.xxh3_128_digest(f"{len(r)}:{r}{t}".encode())
            if s != "d" and digest in seen:
                s = "D"
            elif s != "d":
                seen.add(digest)
                fresh.append((i, digest))
            symbols.append(s)
        initials = [r[:1] for r in roles]
        bad = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return (last, part + made, "".join(symbols), bad, initials[0], initials[-1], [i for i, _ in fresh], [d for _, d in fresh], roles, texts)

    columns = ["cid", "seg", "symbols", "bad", "first", "last", "places", "digests", "roles", "texts"]
    for batch in batches:
        out, waiting = [], 0
        for cid, role, text in zip(batch["cid"], batch["role"], batch["text"]):
            if roles and (cid != last or len(roles) >= ROWS or held + len(text) > CHARS):
                out.append(segment())
                waiting += held
                made, roles, texts, held = made + 1, [], [], 0
                if waiting > 4 * CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, waiting = [], 0
            last = cid
            roles.append(role)
            texts.append(text)
            held += len(text)
        if out:
            yield pd.DataFrame(out, columns=columns)
    if roles:
        yield pd.DataFrame([segment()], columns=columns)


class Automaton:
    """Nodes of signatures' endings.

    A node is (costs, edits): per grammar state the least cost of repairing the
    ending, and the first edit of the best repair.  Of equal costs the edit of
    the least letter wins: options of a state differ in their letter and lead to
    one state each, so this gives the least audit as a whole.
    """

    def __init__(self):
        self.stack = [self.settled([(0, ""), (np.inf, ""), (np.inf, ""), (0, "")])]
        self.known: dict[tuple, tuple] = {}
        self.ending = ""

    @staticmethod
    def settled(best: list[tuple[float, str]]) -> tuple[tuple, tuple]:
        """Adds insertions, of which a state takes two at most."""
        for _ in range(3):
            best = [min(b, (INSERT + best[NEXT[s]][0], "I")) for s, b in enumerate(best)]
        return tuple(b[0] for b in best), tuple(b[1] for b in best)

    def node(self, s: str, below: tuple) -> tuple[tuple, tuple]:
        """The node of an ending that starts with symbol ``s`` before the ending ``below``; shared by equal costs."""
        least = min(below)
        key = (s, tuple(c - least for c in below))
        if key not in self.known:
            costs, best = key[1], []
            for state in range(4):
                options = [(DELETE + costs[state], "D")]
                if s not in "dD":
                    more = TRUNCATED if s.isupper() else 0
                    options.append((REROLE + more + costs[NEXT[state]], "R"))
                    kept = KEPT.get(s.lower(), {}).get(state)
                    if kept is not None:
                        options.append((KEEP + more + costs[kept], "K"))
                best.append(min(options))
            self.known[key] = self.settled(best)
        costs, edits = self.known[key]
        return tuple(c + least for c in costs), edits

    def add(self, signature: str) -> tuple[int, str]:
        """(cost, audit); endings shared with the signature before are not worked out again."""
        ending = signature[::-1]
        same = next((i for i, (a, b) in enumerate(zip(ending, self.ending)) if a != b), min(len(ending), len(self.ending)))
        del self.stack[same + 1 :]
        for s in ending[same:]:
            self.stack.append(self.node(s, self.stack[-1][0]))
        self.ending = ending
        audit, state = [], START
        for s, (_, edits) in zip(signature + " ", reversed(self.stack)):
            while edits[state] == "I":
                audit.append("I")
                state = NEXT[state]
            audit.append(edits[state])
            if edits[state] == "R":
                state = NEXT[state]
            elif edits[state] == "K":
                state = KEPT[s.lower()][state]
        return int(self.stack[-1][0][START]), "".join(audit)


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = Automaton()
    for batch in batches:
        yield pd.DataFrame([(s, *automaton.add(s)) for s in batch["signature"]], columns=["signature", "cost", "audit"])


def signature_repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the different values of ``signatures.signature``.

    They are dealt out by ranges of their reversed form and read in its order, so
    all signatures of a common ending meet in one task, or in neighbouring ones,
    and each task holds the nodes of one path.
    """
    rev = F.reverse("signature")
    dealt = signatures.distinct().repartitionByRange(F.substring(rev, 1, 256), F.xxhash64("signature")).sortWithinPartitions(rev)
    return dealt.mapInPandas(_repairs, "signature string, cost long, audit string")


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each conversation's repaired rows; its audit comes before its segments."""
    last, sha, audit, at, state, first = None, None, "", 0, START, True
    said = {USER: "user", ASSISTANT: "assistant"}

    def put(line: str):
        nonlocal first
        sha.update((line if first else "\n" + line).encode())
        first = False

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            put(f"{said[state]}:")

    def done():
        inserted()
        return last, sha.hexdigest()

    for batch in batches:
        out = []
        for cid, seg, whole, roles, texts in zip(batch["cid"], batch["seg"], batch["audit"], batch["roles"], batch["texts"]):
            if seg < 0:
                if sha:
                    out.append(done())
                last, sha, audit, at, state, first = cid, hashlib.sha256(), whole, 0, START, True
                continue
            for role, text in zip(roles, texts):
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEPT[role[:1]][state]
                    put(f"{role}:{text}")
                elif edit == "R":
                    state = NEXT[state]
                    put(f"{said[state]}:{text}")
        yield pd.DataFrame(out, columns=["cid", "repaired_sha256"])
    if sha:
        yield pd.DataFrame([done()], columns=["cid", "repaired_sha256"])


@F.pandas_udf(T.StringType())
def _with_repeats(symbols: pd.Series, again: pd.Series) -> pd.Series:
    out = []
    for s, places in zip(symbols, again):
        if places is not None and len(places):
            s = list(s)
            for i in places:
                s[i] = "D"
            s = "".join(s)
        out.append(s)
    return pd.Series(out, dtype=object)


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of damaged rows.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the
    MD5 of their text.  Null roles and texts read as one space, so such texts are
    blank; null ids are one conversation; a role counts by its initial, and one
    that is none of s, u and a can only be reroled or deleted.  Rows that repeat
    are duplicates.  Other columns are ignored; an empty table gives no rows.

    Whether a row was said before is found by 128-bit digests: inside a segment
    at once, between segments by a reduced grouping.  All that a conversation
    brings to one task is a symbol a row and, for its hash, its text as a stream.
    """
    spark = talks.sparkSession
    bound_batches(spark)
    cid: Column = F.coalesce(F.concat(F.lit("#"), F.col(conv).cast("string")), F.lit(""))
    given = talks.select(cid.alias("cid"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    # rows that agree in all of this are alike: any of them may come first, and ranges can part them
    order = ["cid", F.col("turn").asc_nulls_first(), "role", F.md5("text"), "near"]
    dealt = given.withColumn("near", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = cut(dealt.select("cid", "role", "text").mapInPandas(
        _segments,
        "cid string, seg long, symbols string, bad long, first string, last string, places array<int>, digests array<binary>, "
        "roles array<string>, texts array<string>",
    ), "segments")
    narrow = segments.drop("roles", "texts")
    several = narrow.groupBy("cid").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("cid")
    fresh = narrow.join(several, "cid", "left_semi").select("cid", "seg", F.explode(F.arrays_zip("places", "digests")).alias("o"))
    fresh = fresh.select("cid", "seg", "o.places", "o.digests")
    first = fresh.groupBy("cid", "digests").agg(F.min("seg").alias("first"), F.max("seg").alias("again")).where("first < again").drop("again")
    again = fresh.join(first, ["cid", "digests"]).where("seg > first").groupBy("cid", "seg").agg(F.collect_list("places").alias("again"))
    marked = narrow.drop("places", "digests").join(again, ["cid", "seg"], "left").select(
        "cid", "seg", "bad", "first", "last", _with_repeats("symbols", "again").alias("symbols")
    )
    whole = marked.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("seg", "symbols", "first", "last"))).alias("s"), F.sum("bad").alias("bad"))
    seam = F.zip_with(F.slice("s.last", F.lit(1), F.size("s") - 1), F.slice("s.first", F.lit(2), F.size("s") - 1), lambda a, b: F.concat(a, b))
    seams = F.size(F.filter(seam, lambda x: ~x.isin(*LEGAL)))
    signature = F.concat_ws("", "s.symbols")
    signed = cut(whole.select("cid", signature.alias("signature"), (F.col("bad") + seams).alias("illegal")), "signatures")
    repairs = cut(signature_repairs(signed.select("signature")), "repairs")
    repaired = cut(signed.join(repairs, "signature"), "repaired")
    none = F.lit(None).cast("array<string>")
    stream = repaired.select("cid", F.lit(-1).cast("bigint").alias("seg"), "audit", none.alias("roles"), none.alias("texts")).unionAll(
        segments.select("cid", "seg", F.lit(None).cast("string").alias("audit"), "roles", "texts")
    )
    hashes = stream.repartition("cid").sortWithinPartitions("cid", "seg").mapInPandas(_rewritten, "cid string, repaired_sha256 string")
    turns = given.groupBy("cid").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("bigint")
    often = lambda letters: F.length("signature") - F.length(F.translate("signature", letters, ""))
    ids = talks.select(F.col(conv).alias("conv_id")).distinct()
    known = repaired.join(turns, "cid").join(hashes, "cid")
    return ids.withColumn("cid", F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit(""))).join(known, "cid").select(
        "conv_id", gaps.alias("gaps"), often("d").cast("bigint").alias("blank"), often("D").cast("bigint").alias("duplicate"),
        often("SUAX").cast("bigint").alias("truncated"), F.col("illegal").cast("bigint").alias("illegal"), "cost", "audit", "repaired_sha256",
    )


def with_untouched(ids: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row for every id of ``ids.conv_id``: zeros, an empty audit and the empty text's hash where no row is left."""
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    all_ids = ids.select(F.col("conv_id").alias("id")).distinct()
    found = all_ids.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return found.select(
        F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
