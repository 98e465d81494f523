"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.bytehash import ByteHasher
from cladeloom.llm.common import body, bound_batches
from cladeloom.runtime import cut

#: Tokens of a template window; an item of fewer tokens is one window.
WINDOW = 8
#: Items below this length have no template windows, those below the second length are no evidence and are never found.
LEAST_TOKENS, LEAST_LITERAL = 5, 3
#: Share of a window's tokens that are ordinary words, share of an item that
#: windows cover, and share of its slots that keep one consistent value.
LITERAL, COVERED, CONSISTENT = 0.5, 0.5, 0.8
#: Benchmark text that one index holds; larger benchmarks are searched in blocks.
BLOCK_BYTES = 16 << 20
#: Leading bits of window hashes that are looked up before the hashes themselves.
FIRST_BITS = 20

_NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_UNITS = frozenset(
    "percent dollar dollars cent cents euro euros pound pounds inch inches foot feet yard yards mile miles meter meters metre"
    " metres centimeter centimeters kilometer kilometers kilometre kilometres gram grams kilogram kilograms ounce ounces liter"
    " liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees"
    " mph kmh celsius fahrenheit watt watts volt volts".split()
) | frozenset("%$€£")
#: Units only right after a number.
_SHORT_UNITS = frozenset("m g s h l km cm mm kg mg lb lbs oz ft mi ml kw hz c f k v w".split())
WORD, NUMBER, NAME, UNIT, END = range(5)


# Kinds of bytes: letters (and all bytes beyond ASCII), digits, marks that are tokens of their own, the rest.
_LETTER, _DIGIT, _MARK = 1, 2, 3
_BYTE = np.zeros(256, dtype=np.int8)
_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_BYTE[48:58] = _DIGIT
_BYTE[list(b".!?%$")] = _MARK
_INSIDE = {_DIGIT: np.isin(np.arange(256), list(b".,:/")), _LETTER: np.arange(256) == ord("'")}
#: Characters beyond ASCII that separate words, and their plain forms.
_PLAIN = {"\u2019": "'", **dict.fromkeys("\u00a0\u2018\u201c\u201d\u201e\u00ab\u00bb\u00bf\u00a1\u2026\u2013\u2014", " ")}
_PLAIN |= dict.fromkeys("\u3000\u3001\u300a\u300b\u300c\u300d\u300e\u300f\uff08\uff09\uff0c\uff1a\uff1b", " ") | {"\u3002": ".", "\uff01": "!", "\uff1f": "?"}


def _lower(text: str) -> str:
    """Lower case at unchanged places: characters whose lower case is longer or shorter stay."""
    low = text.lower()
    if len(low.encode()) == len(text.encode()):
        return low
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text)


def _alone(data: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin or follow a character of a script without spaces.

    Such are Thai and Lao, Burmese and Khmer, kana and Han: each character is a token.
    """
    two = np.append(data[1:], 0)
    begins = (data >= 0xE3) & (data <= 0xE9)
    begins |= (data == 0xE0) & (two >= 0xB8) & (two <= 0xBB)
    begins |= (data == 0xE1) & (((two >= 0x80) & (two <= 0x82)) | (two == 0x9E) | (two == 0x9F))
    begins |= (data == 0xF0) & (two >= 0xA0) & (two <= 0xAF)
    at = np.flatnonzero(begins)
    after = at + np.where(data[at] == 0xF0, 4, 3)
    return np.concatenate([at, after[after < len(data)]])


class Tokens(ByteHasher):
    """Cuts texts into tokens and tells their kinds, all tokens of a text at once."""

    def __init__(self):
        super().__init__()
        words = sorted(_NUMBERS | _UNITS | _SHORT_UNITS | set(".!?"))
        parts = [np.frombuffer(w.encode(), dtype=np.uint8) for w in words]
        ends = np.cumsum([len(x) for x in parts])
        h = self.words(np.concatenate(parts), ends - [len(x) for x in parts], ends)
        kind = [END if w in ".!?" else NUMBER if w in _NUMBERS else UNIT if w in _UNITS else WORD for w in words]
        order = np.argsort(h)
        self.known, self.kind = h[order], np.array(kind, dtype=np.int8)[order]
        self.short = np.array([w in _SHORT_UNITS for w in words])[order]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(value, kind, capital, short unit) of each token."""
        if not text.isascii():
            for a, b in _PLAIN.items():
                if a in text:
                    text = text.replace(a, b)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        low = np.frombuffer(_lower(text).encode(), dtype=np.uint8)
        kind = _BYTE[data]
        for k, inside in _INSIDE.items():
            at = np.flatnonzero(inside[data])
            at = at[(at > 0) & (at < len(data) - 1)]
            kind[at[(kind[at - 1] == k) & (_BYTE[data[at + 1]] == k)]] = k
        first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _MARK)])[: len(kind)]
        if not text.isascii():
            first[_alone(data)] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(kind)) if len(starts) else starts
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        value = self.words(low, starts, ends)
        at = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
        listed = self.known[at] == value
        kinds = np.where(listed, self.kind[at], np.where(kind[starts] == _DIGIT, NUMBER, WORD))
        second = np.minimum(starts + 1, ends - 1)
        capital = ((low[starts] != data[starts]) | (low[second] != data[second])) & (ends - starts > 1)
        return value, kinds, capital, listed & self.short[at]


#: A placeholder's hash per kind of slot.
_PLACEHOLDER = np.array([0, 0x1F123BB5, 0x2545F491, 0x369DEA0F, 0], dtype=np.uint64)


@dataclass
class Template:
    """A text's tokens: lower-case values, and per form their kinds and canonical hashes.

    The first form makes names of capitalised words inside a sentence; the
    second knows no names, so it also reads texts whose case was changed; the
    third is the values themselves.
    """

    values: np.ndarray
    kinds: tuple[np.ndarray, np.ndarray, np.ndarray]
    hashes: tuple[np.ndarray, np.ndarray, np.ndarray]


def canonical(text: str, tokens: Tokens) -> Template:
    value, kind, capital, short = tokens.read(text)
    before = np.concatenate([[END], kind[:-1]])[: len(kind)]
    plain = np.where(short & (before == NUMBER), UNIT, kind)
    named = np.where((plain == WORD) & capital & (before != END), NAME, plain)
    real = kind != END
    plain, named, value = plain[real], named[real], value[real]
    hashes = tuple(np.where(k == WORD, value, _PLACEHOLDER[k]) for k in (named, plain))
    return Template(value, (named, plain, plain), (*hashes, value))


class Index:
    """Windows of a block of benchmark items by their hashes, in sorted arrays."""

    def __init__(self, items: list[tuple[object, str]]):
        self.tokens = Tokens()
        self.items = [(i, canonical(t or "", self.tokens)) for i, t in items]
        places: dict[tuple[int, int], dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for n, (_, t) in enumerate(self.items):
            length = min(WINDOW, len(t.values))
            if length < LEAST_LITERAL:
                continue
            literal = True
            for form in (0, 1) if length >= LEAST_TOKENS else ():
                words = np.concatenate([[0], np.cumsum(t.kinds[form] == WORD)])
                enough = words[length:] - words[:-length] >= LITERAL * length
                h = self.tokens.runs(t.hashes[form], length)
                for q in np.flatnonzero(enough):
                    places[form, length][int(h[q])].append((n, int(q)))
                literal &= not enough.any()
            if literal:  # no template tells this item: only its own values do
                for q, h in enumerate(self.tokens.runs(t.values, length).tolist()):
                    places[2, length][h].append((n, q))
        self.windows = {}
        for k, v in places.items():
            known = np.sort(np.array(list(v), dtype=np.uint64))
            # most windows of a text are told apart from all known ones by their first bits
            begins = np.zeros(1 << FIRST_BITS, dtype=bool)
            begins[known >> np.uint64(64 - FIRST_BITS)] = True
            self.windows[k] = (begins, known, dict(v))

    def hits(self, t: Template) -> dict[int, list[tuple[int, int, int, int]]]:
        """item -> (form, place in the text, place in the item, length) of equal windows."""
        found = defaultdict(list)
        for (form, length), (begins, known, places) in self.windows.items():
            h = self.tokens.runs(t.hashes[form], length)
            maybe = np.flatnonzero(begins[h >> np.uint64(64 - FIRST_BITS)])
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            for p in maybe[known[at] == h[maybe]].tolist():
                for n, q in places[int(h[p])]:
                    own = self.items[n][1].hashes[form]
                    if np.array_equal(own[q : q + length], t.hashes[form][p : p + length]):
                        found[n].append((form, p, q, length))
        return found

    def leaks(self, text: str) -> list[tuple]:
        """(item_id, coverage, slots, changed) of each item that the text holds."""
        t = canonical(text, self.tokens)
        out = []
        for n, hits in self.hits(t).items():
            item_id, item = self.items[n]
            best = max((best_of(chain, t, item) for chain in chains(hits, len(item.values))), key=lambda x: (x[0], -x[2]))
            if best[0] >= COVERED:
                out.append((item_id, *best))
        return out


def chains(hits: list[tuple[int, int, int, int]], reach: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Hits of one item that lie within an item's length of each other in the text."""
    hits = sorted(hits, key=lambda x: x[1])
    chain = hits[:1]
    for h in hits[1:]:
        if h[1] - chain[-1][1] > reach:
            yield chain
            chain = []
        chain.append(h)
    yield chain


def alignments(chain: list[tuple[int, int, int, int]], text: Template, item: Template) -> Iterator[dict[int, tuple[int, int]]]:
    """Ways to lay the item along the text: place in the item -> (place in the text, kind).

    Each diagonal (place in the text less place in the item) is one, by itself
    and with what other diagonals, nearest first, add without crossing it.  So
    a literal copy pairs with itself, however often windows repeat.  Diagonals
    further apart than the item is long are not of one occurrence.
    """
    diagonals = defaultdict(list)
    for form, p, q, length in chain:
        diagonals[p - q].append((form, q, length))
    every = {q + k for _, _, q, length in chain for k in range(length)}
    ordered = sorted(diagonals)

    def add(laid: dict, places: list[int], d: int) -> None:
        for form, q, length in diagonals[d]:
            for k in range(q, q + length):
                if k not in laid:
                    i = bisect_left(places, k)
                    if (i and laid[places[i - 1]][0] >= k + d) or (i < len(places) and laid[places[i]][0] <= k + d):
                        continue
                    places.insert(i, k)
                    laid[k] = (k + d, WORD)
                if laid[k] == (k + d, WORD):
                    laid[k] = (k + d, int(item.kinds[form][k]))

    reach, seen = len(item.values), set()
    for d in sorted(ordered, key=lambda d: -len(diagonals[d])):
        # what lies within reach decides: where a text repeats itself, once is enough
        at, to = max(0, d - reach), max(0, d + 2 * reach)
        around = (min(0, d - reach), *(x[at:to].tobytes() for x in text.hashes))
        if around in seen:
            continue
        seen.add(around)
        laid: dict[int, tuple[int, int]] = {}
        places: list[int] = []
        add(laid, places, d)
        yield dict(laid)
        low = bisect_left(ordered, d) - 1
        high, more = low + 2, False
        least, most = bisect_left(ordered, d - reach), bisect_left(ordered, d + reach + 1)
        while len(laid) < len(every) and (low >= least or high < most):
            if high == most or (low >= least and d - ordered[low] <= ordered[high] - d):
                low, other = low - 1, ordered[low]
            else:
                high, other = high + 1, ordered[high]
            add(laid, places, other)
            more = True
        if more:
            yield laid


def best_of(chain: list[tuple[int, int, int, int]], text: Template, item: Template) -> tuple[float, int, int]:
    """``judged`` of the alignment that covers most, with the fewest changed slots."""
    best = (0.0, 0, 0)
    for laid in alignments(chain, text, item):
        now = judged(laid, text, item)
        best = max(best, now, key=lambda x: (x[0], -x[2]))
        if best[0] == 1 and not best[2]:
            break
    return best


def judged(laid: dict[int, tuple[int, int]], text: Template, item: Template) -> tuple[float, int, int]:
    """(coverage, slots, changed slots); no coverage if the slots contradict each other.

    Aligned slots give pairs of an item's value and the text's.  Filled in anew,
    a question gives each of its values one new value and no value to two; slots
    that keep to the most frequent pairing both ways are consistent.
    """
    pairs = Counter((kind, int(item.values[q]), int(text.values[p])) for q, (p, kind) in sorted(laid.items()) if kind != WORD)
    there, back = {}, {}
    for (kind, a, b), _ in sorted(pairs.items(), key=lambda x: -x[1]):
        there.setdefault((kind, a), b)
        back.setdefault((kind, b), a)
    slots = sum(pairs.values())
    kept = sum(n for (kind, a, b), n in pairs.items() if there[kind, a] == b and back[kind, b] == a)
    changed = sum(n for (_, a, b), n in pairs.items() if a != b)
    same = slots - changed
    consistent = not slots or max(kept, same) >= CONSISTENT * slots
    return (len(laid) / len(item.values) if consistent else 0.0), slots, changed


def _leak_column(shared, kind: str):
    names = ("item_id", "coverage", "slots", "changed")

    @F.pandas_udf(kind)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(names, x)) for x in shared.value.leaks(t)] for t in batch])

    return leaks


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``leaks``: array<struct<item_id, coverage, slots, changed>>.

    Numbers, units and names become typed placeholders.  Windows of WINDOW
    tokens with enough ordinary words are looked up among those of the items;
    equal ones are aligned, and an item is reported if windows cover COVERED of
    its tokens and its slots are filled consistently.  ``changed`` counts slots
    with another value than the item's: 0 in a literal copy.

    An item without such a window, for want of words or of tokens, is known by
    its own values instead, so only as it stands.

    Whole texts are read once per block of BLOCK_BYTES of the benchmark.  One
    block needs no shuffle; several are searched one after the other, each with
    its own index, and what they find is written and joined to the rows.  Null
    and empty texts hold nothing; null items and those below LEAST_LITERAL tokens
    are never held; an empty benchmark gives empty arrays.  Rows that repeat give
    equal results.  A column named ``leaks`` is replaced, all others stay.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    found = f"array<struct<item_id:{kind},coverage:double,slots:int,changed:int>>"
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)

    def index(b: int):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in part.collect()), key=str)))

    if blocks == 0:
        return docs.withColumn("leaks", F.array().cast(found))
    if blocks == 1:
        return docs.withColumn("leaks", _leak_column(index(0), found)(body(text_col)))
    rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    parts = []
    for b in range(blocks):
        shared = index(b)
        parts.append(cut(rows.select("row", _leak_column(shared, found)(body(f"doc.{text_col}")).alias("leaks")).where(F.size("leaks") > 0), "leaks"))
        shared.destroy()
    held = reduce(DataFrame.union, parts).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != "leaks"]
    return rows.join(held, "row", "left").select(*kept, F.coalesce("leaks", F.array().cast(found)).alias("leaks"))
