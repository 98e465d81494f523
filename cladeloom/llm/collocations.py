"""Phrase mining with counting quotient filters over packed word-id n-grams.

An n-gram of word ids is one number of n * bits bits.  A Feistel permutation,
which can be undone, spreads it evenly; its upper bits name a shard and a slot
(the quotient), all others are kept in full (the remainder).  So a filter loses
nothing: it lists its n-grams in order in little more than their remainders, and
filters of one shard merge by their order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.common import batches_of, body, bound_batches
from cladeloom.runtime import cut

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate inside a longer one with this percentage of its count goes.
HELD = 80
#: Words of a block, words of one set of filters, and blocks that travel to a task together.
BLOCK_WORDS, FILTER_WORDS, BLOCKS_TOGETHER = 1 << 19, 1 << 21, 16
#: Words per shard of a filter, about.
SHARD_WORDS = 1 << 21
_ENDS = re.compile(rb"[.,;:!?\n-\r]+")
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def tokens(text: str) -> list[bytes]:
    """Words in lower case (ASCII letters only), with a full stop between pieces."""
    return _ENDS.sub(b" . ", text.encode().lower()).split()


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _halves(n: int, bits: int) -> tuple[int, int]:
    """Bits of the upper and the lower part of a packed n-gram."""
    upper = (n + 1) // 2
    return upper * bits, (n - upper) * bits


def permute(hi: np.ndarray, lo: np.ndarray, n: int, bits: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram's two parts after the rounds of a Feistel network, or before them."""
    h, l = _halves(n, bits)
    for i, m in reversed(list(enumerate(_ROUNDS))) if back else enumerate(_ROUNDS):
        a = lo if i % 2 else hi
        x = (a + np.uint64(i + 1)) * np.uint64(m)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_ROUNDS[0])
        x ^= x >> np.uint64(32)
        if i % 2:
            hi = hi ^ (x & _mask(h))
        else:
            lo = lo ^ (x & _mask(l))
    return hi, lo


def pack(ids: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the n-grams whose words are ``ids``[i, 0..n-1]."""
    upper = (n + 1) // 2
    parts = []
    for cols in (range(upper), range(upper, n)):
        x = np.zeros(len(ids), dtype=np.uint64)
        for c in cols:
            x = (x << np.uint64(bits)) | ids[:, c].astype(np.uint64)
        parts.append(x)
    return parts[0], parts[1]


def unpack(hi: np.ndarray, lo: np.ndarray, n: int, bits: int) -> np.ndarray:
    upper, out = (n + 1) // 2, np.zeros((len(hi), n), dtype=np.int64)
    for x, cols in ((hi, range(upper - 1, -1, -1)), (lo, range(n - 1, upper - 1, -1))):
        for c in cols:
            out[:, c] = (x & _mask(bits)).astype(np.int64)
            x = x >> np.uint64(bits)
    return out


def counted(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different (hi, lo) with their counts added up; ``width`` bits of lo."""
    if not len(hi):
        return hi, lo, np.zeros(0, dtype=np.int64)
    if not int(hi.max()) >> (64 - width):
        whole = (hi << np.uint64(width)) | lo
        if counts is None:
            whole, n = np.unique(whole, return_counts=True)
        else:
            order = np.argsort(whole, kind="stable")
            whole, counts = whole[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            whole, n = whole[at], np.add.reduceat(counts, at)
        return whole >> np.uint64(width), whole & _mask(width), n.astype(np.int64)
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    counts = np.ones(len(hi), dtype=np.int64) if counts is None else counts[order]
    at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[at], lo[at], np.add.reduceat(counts, at)


def _bytes_of(x: np.ndarray, bits: int) -> bytes:
    """Numbers of up to ``bits`` bits in as few whole bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]).tobytes()


def _numbers(data: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    width = (bits + 7) // 8
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(n, width)
    return out.view("<u8").reshape(-1).astype(np.uint64)


class QuotientFilter:
    """A counting quotient filter of sorted n-grams that share their upper ``shard_bits``.

    ``occupied`` has a bit per quotient that is there, ``ends`` a bit per n-gram
    that is the last of its quotient.  Remainders are those of the upper part and
    the lower part in full; counts take a byte each, larger ones are listed.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray):
        self.hi, self.lo, self.counts = hi, lo, counts

    def dump(self, h: int, l: int, shard_bits: int) -> bytes:
        n = len(self.hi)
        q = max(0, min(h - shard_bits, n.bit_length() - 1))
        rest = h - shard_bits - q
        own = self.hi & _mask(h - shard_bits)
        quotient = (own >> np.uint64(rest)).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
        small = np.minimum(self.counts, 255).astype(np.uint8)
        large = self.counts[small == 255]
        head = np.array([n, q, len(large)], dtype="<u8").tobytes()
        remainders = _bytes_of(own & _mask(rest), rest) + _bytes_of(self.lo, l)
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders, small.tobytes(), large.astype("<i8").tobytes()])

    @classmethod
    def load(cls, data: bytes, h: int, l: int, shard: int, shard_bits: int) -> QuotientFilter:
        n, q, k = (int(x) for x in np.frombuffer(data, dtype="<u8", count=3))
        rest, at = h - shard_bits - q, 24

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]

        occupied = np.unpackbits(np.frombuffer(take(((1 << q) + 7) // 8), dtype=np.uint8))[: 1 << q]
        ends = np.unpackbits(np.frombuffer(take((n + 7) // 8), dtype=np.uint8))[:n]
        run = np.cumsum(ends) - ends  # the how manieth quotient an n-gram belongs to
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
        low = _numbers(take(n * ((rest + 7) // 8)), rest, n)
        lo = _numbers(take(n * ((l + 7) // 8)), l, n)
        counts = np.frombuffer(take(n), dtype=np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(take(8 * k), dtype="<i8")
        return cls((np.uint64(shard) << np.uint64(h - shard_bits)) | (quotient << np.uint64(rest)) | low, lo, counts)

    @classmethod
    def merged(cls, filters: list[QuotientFilter], l: int) -> QuotientFilter:
        hi, lo, counts = (np.concatenate([getattr(f, x) for f in filters]) for x in ("hi", "lo", "counts"))
        return cls(*counted(hi, lo, counts, l))


class Numbers(dict):
    """Numbers words from 1 on as they come; a break between pieces is 0."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, lang, words, counts, width, stream): texts as streams of numbers, with the words that they stand for."""
    part, made = TaskContext.get().partitionId() << 32, 0
    held: dict[str, tuple[Numbers, list]] = {}

    def block(lang: str) -> pd.DataFrame:
        nonlocal made
        numbers, texts = held.pop(lang)
        stream = np.array(list(chain.from_iterable(texts)), dtype=np.uint32)
        counts = np.bincount(stream, minlength=len(numbers))
        width = 2 if len(numbers) < 1 << 16 else 4
        made += 1
        words = [w.decode() for w in numbers]
        data = stream.astype(f"<u{width}").tobytes()
        return pd.DataFrame([(part + made, lang, words, counts, width, data)], columns=["block", "lang", "words", "counts", "width", "stream"])

    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            numbers, texts = held.setdefault(lang, (Numbers(), []))
            words = tokens(text)
            words.append(b".")
            for at in range(0, len(words), BLOCK_WORDS):
                texts.append([numbers[w] for w in words[at : at + BLOCK_WORDS]])
            sizes[lang] += len(words)
            if sizes[lang] > BLOCK_WORDS:
                del sizes[lang]
                yield block(lang)
    for lang in list(held):
        yield block(lang)


def _filters(shards: int):
    """Numbers the words of each chunk by its part of the vocabulary and emits filters."""

    def emit(lang: str, ids: list[np.ndarray], bits: int) -> Iterator[tuple]:
        w = np.concatenate(ids)
        for n in range(2, LONGEST + 1):
            if len(w) < n:
                break
            windows = np.lib.stride_tricks.sliding_window_view(w, n)
            windows = windows[(windows > 0).all(axis=1)]
            h, l = _halves(n, bits)
            hi, lo, counts = counted(*permute(*pack(windows, n, bits), n, bits), None, l)
            s = min(h, shards)
            shard = (hi >> np.uint64(h - s)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                yield lang, n, bits, int(shard[a]), QuotientFilter(hi[a:b], lo[a:b], counts[a:b]).dump(h, l, s)

    columns = ["lang", "n", "bits", "shard", "filter"]

    def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        width: dict[str, int] = {}
        for batch in batches:
            for lang, size, data, bits, known in zip(batch["lang"], batch["width"], batch["stream"], batch["bits"], batch["known"]):
                stream = np.frombuffer(data, dtype=f"<u{size}")
                number = np.zeros(int(stream.max(initial=0)) + 1, dtype=np.int64)
                pairs = np.array([(k["at"], k["id"]) for k in known], dtype=np.int64)
                number[pairs[:, 0]] = pairs[:, 1]
                held.setdefault(lang, []).append(number[stream])
                width[lang] = bits
                if sum(map(len, held[lang])) > FILTER_WORDS:
                    yield pd.DataFrame(list(emit(lang, held.pop(lang), bits)), columns=columns)
        for lang, ids in held.items():
            yield pd.DataFrame(list(emit(lang, ids, width[lang])), columns=columns)

    return filters


def _merge(shards: int):
    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lang, n, bits, shard = key
        n, bits, shard = int(n), int(bits), int(shard)
        h, l = _halves(n, bits)
        s = min(h, shards)
        whole, waiting, size = None, [], 0
        for data in part["filter"]:
            waiting.append(QuotientFilter.load(data, h, l, shard, s))
            size += len(waiting[-1].hi)
            if size > FILTER_WORDS:
                whole, waiting, size = QuotientFilter.merged([*([whole] if whole else []), *waiting], l), [], 0
        whole = QuotientFilter.merged([*([whole] if whole else []), *waiting], l)
        often = whole.counts >= LEAST
        ids = unpack(*permute(whole.hi[often], whole.lo[often], n, bits, back=True), n, bits)
        return pd.DataFrame({"lang": lang, "n_words": n, "ids": pd.Series(list(ids), dtype=object), "a": whole.counts[often]})

    return merge


def _numbered(words: DataFrame) -> DataFrame:
    """(lang, word, f, id, bits): words from 1 on within each language, dealt to parts first so that no task numbers all."""
    parts = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(256)))
    sizes = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    offset = F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bits = F.length(F.bin(F.sum("size").over(Window.partitionBy("lang")))).cast("int")
    sizes = sizes.select("lang", "part", F.coalesce(offset, F.lit(0)).alias("offset"), bits.alias("bits"))
    number = F.row_number().over(Window.partitionBy("lang", "part").orderBy("word"))
    return parts.withColumn("number", number).join(sizes, ["lang", "part"]).select(
        "lang", "word", "f", (F.col("offset") + F.col("number")).alias("id"), "bits"
    )


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, n_words, f) of all phrases of 1 to LONGEST words found LEAST times or more, and (lang, n).

    1. Tasks write their texts as blocks: streams of block-wide word numbers, and
       the words with their counts.
    2. Words found LEAST times over all blocks get numbers within their language.
       No rarer word is part of a frequent phrase.
    3. Each block gets the numbers of its own words, so nothing that grows with
       the corpus is broadcast, and is turned into filters of n-grams per
       language, length and shard.
    4. Filters of a shard are merged; frequent n-grams are permuted back.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    given = docs.select(lang, body(text_col).alias("text"))
    blocks = cut(given.mapInPandas(
        _blocks, "block long, lang string, words array<string>, counts array<long>, width int, stream binary"
    ), "word-blocks")
    zipped = F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")
    words = blocks.select("block", "lang", zipped).where("at > 0").select("block", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted_words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = cut(counted_words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    vocabulary = cut(_numbered(counted_words.where(F.col("f") >= LEAST)), "vocabulary")
    total = totals.agg(F.sum("n")).first()[0] or 0
    shards = (total // SHARD_WORDS).bit_length()
    known = words.drop("n").join(vocabulary.drop("f"), ["lang", "word"])
    known = known.groupBy("block").agg(F.max("bits").alias("bits"), F.collect_list(F.struct("at", "id")).alias("known"))
    numbered = blocks.select("block", "lang", "width", "stream").join(known, "block")
    filters = numbered.mapInPandas(_filters(shards), "lang string, n int, bits int, shard long, filter binary")
    grams = filters.groupBy("lang", "n", "bits", "shard").applyInPandas(_merge(shards), "lang string, n_words int, ids array<long>, a long")
    with batches_of(spark, BLOCKS_TOGETHER):
        grams = cut(grams, "frequent-grams")
    spelt = grams.select("lang", "n_words", "a", F.posexplode("ids").alias("at", "id"), F.xxhash64("n_words", "ids").alias("gram"), "ids")
    spelt = spelt.join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ")
    spelt = spelt.groupBy("lang", "ids").agg(phrase.alias("phrase"), F.max("n_words").alias("n_words"), F.max("a").alias("f"))
    single = vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "f")
    return cut(single.unionAll(spelt.select("lang", "phrase", "n_words", "f")), "phrase-counts"), totals


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to LONGEST words.

    ``score`` is 2,000,000 a / (l + r), rounded down, of the phrase's worst cut
    into a first part found l times and a rest found r times.  Phrases inside a
    longer one with at least HELD percent of their count are dropped.  Ties in
    score go to the larger count, then to the phrase of the lesser bytes.

    Null languages are ``und``, null texts empty; texts without words add
    nothing, rows that repeat count as often.  Other columns are ignored; an
    empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col)
    found = counts.where("n_words > 1").withColumnRenamed("f", "a")
    k = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = found.select("lang", "phrase", "n_words", "a", k).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - n_words)").alias("rest")
    )
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "n_words", "a").agg(worst)

    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
    )))
    inside = found.where("n_words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(20, 0)")
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big("longer") < HELD * big("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.select("*", rank.alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
