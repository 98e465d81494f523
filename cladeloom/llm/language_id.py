"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body, bound_batches, id_key
from cladeloom.runtime import cut

ORDER, LANE = 4, 16
UNKNOWN = "und"
#: Entries of the models that a task holds at a time, about; larger models are scored shard after shard.
SHARD_GRAMS = 4_000_000
#: Labelled documents on which scores and rejection are calibrated, about, and the least distance between two of them.
CALIBRATION, APART = 4000, 5
#: A document is rejected beyond so many times the worst calibration document.
SLACK = 1.25
#: Characters and texts handled together, and grams held before a task hands them on.
CHUNK, TEXTS, HELD = 1 << 18, 512, 1 << 20
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters, anything else as one space; empty if there is no letter."""
    s = _OTHER.sub(" ", (text or "").lower())
    return s if any(map(str.isalpha, s)) else ""


def _codes(s: str) -> np.ndarray:
    """Characters as 16-bit values: those of the BMP as they are."""
    c = np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    return (c ^ (c >> np.uint64(LANE))) & np.uint64(0xFFFF)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owner) of all grams of the normalised texts, in bounded chunks.

    A key packs ORDER characters; each text starts after ORDER - 1 zeros, so
    every character is the last of exactly one gram.
    """
    pad = "\0" * (ORDER - 1)
    pieces, owners, held = [], [], 0

    def keyed():
        c = _codes("".join(pieces))
        own = np.repeat(np.array(owners), [len(p) for p in pieces])
        k = np.zeros(max(0, len(c) - ORDER + 1), dtype=np.uint64)
        for i in range(ORDER):
            k |= c[i : i + len(k)] << np.uint64(LANE * (ORDER - 1 - i))
        real = c[ORDER - 1 :] != 0
        return k[real], own[ORDER - 1 :][real]

    for owner, s in enumerate(texts):
        for at in range(0, len(s), CHUNK):
            # a later chunk of a long text repeats the characters before it as context
            piece = pad + s[at : at + CHUNK] if at == 0 else "\0" + s[at - ORDER + 1 : at + CHUNK]
            if at:
                yield from _later(piece, owner)
                continue
            pieces.append(piece)
            owners.append(owner)
            held += len(piece)
            if held >= CHUNK:
                yield keyed()
                pieces, owners, held = [], [], 0
    if pieces:
        yield keyed()


def _later(piece: str, owner: int):
    c = _codes(piece[1:])
    k = np.zeros(len(c) - ORDER + 1, dtype=np.uint64)
    for i in range(ORDER):
        k |= c[i : i + len(k)] << np.uint64(LANE * (ORDER - 1 - i))
    yield k, np.full(len(k), owner)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text).

    Tasks add up their own grams before anything is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merged(lang):
            keys, n = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[lang] = [(keys[starts], np.add.reduceat(n, starts))]
            return held[lang][0]

        def rows():
            for lang in list(held):
                keys, n = merged(lang)
                yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

        for batch in batches:
            for lang, mine in batch.groupby("lang"):
                texts = mine["text"].to_list()
                for at in range(0, len(texts), TEXTS):
                    for keys, _ in grams([letters(t) for t in texts[at : at + TEXTS]]):
                        held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                        if sum(len(k) for k, _ in held[lang]) > HELD:
                            merged(lang)
            if sum(len(k) for v in held.values() for k, _ in v) > 2 * HELD:
                yield from rows()
                held.clear()
        if held:
            yield from rows()

    counted = labelled.select("lang", body("text").alias("text")).mapInPandas(count, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """A gram's shard, by its two middle characters.

    So a gram, its context and the gram and context one character shorter all
    lie in one shard, and each shard is a whole model of its grams.
    """
    return ((keys >> np.uint64(LANE)) & np.uint64(0xFFFFFFFF)) % np.uint64(shards)


def _shard_column(shards: int) -> Column:
    return F.shiftrightunsigned("key", LANE).bitwiseAND(F.lit(0xFFFFFFFF)) % shards


@dataclass
class LanguageModel:
    """Per order, sorted keys with log probabilities, and sorted contexts with log back-off weights."""

    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    unseen: float

    def log_p(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Natural log probability of each gram's last character after the others."""
        if n == 0:
            return np.full(len(keys), self.unseen)
        known, p, contexts, weight = self.orders[n - 1]
        if not len(known):
            return self.log_p(keys & np.uint64((1 << (LANE * (n - 1))) - 1), n - 1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out, miss = p[at].copy(), np.flatnonzero(known[at] != keys)
        if len(miss):
            rest = keys[miss]
            context = rest >> np.uint64(LANE)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            low = self.log_p(rest & np.uint64((1 << (LANE * (n - 1))) - 1), n - 1)
            out[miss] = low + np.where(contexts[at] == context, weight[at], 0.0)
        return out


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5


@dataclass
class Whole:
    """What a shard of a language's model needs to know of all its grams."""

    #: Discounts of the orders ORDER to 3.
    discounts: dict[int, float]
    #: Sorted pairs of characters with the number of longer grams that end in them.
    pairs: tuple[np.ndarray, np.ndarray]


def kneser_ney(keys: np.ndarray, n: np.ndarray, whole: Whole | None = None) -> LanguageModel:
    """Interpolated Kneser-Ney from the counts of the longest grams.

    A shorter gram counts the different characters seen before it.  Each order
    discounts by n1 / (n1 + 2 n2) and hands the rest to the order below, the
    last one to all characters alike.  With ``whole``, the grams are those of
    one shard.
    """
    levels = []
    order = np.argsort(keys)
    keys, count = keys[order], n[order]
    for k in range(ORDER, 0, -1):
        if whole and k == 2:
            keys, count = whole.pairs
        context, where = np.unique(keys >> np.uint64(LANE), return_inverse=True)
        total = np.bincount(where, weights=count)
        discount = whole.discounts[k] if whole and k > 2 else discount_of((count == 1).sum(), (count == 2).sum())
        lower = keys & np.uint64((1 << (LANE * (k - 1))) - 1)
        levels.append((keys, np.maximum(count - discount, 0) / total[where], context, discount * np.bincount(where) / total, where, lower))
        keys, count = np.unique(lower, return_counts=True)
    uniform = 1.0 / (len(levels[-1][0]) + 1)
    orders, below = [], None
    for keys, p, context, weight, where, lower in reversed(levels):
        low = uniform if below is None else below[1][np.searchsorted(below[0], lower)]
        below = (keys, p + weight[where] * low)
        orders.append((keys, np.log(below[1]), context, np.log(weight)))
    return LanguageModel(orders, float(np.log(uniform)))


@dataclass
class Shard:
    """The models of all languages for the grams of one shard."""

    models: list[LanguageModel]
    number: int
    shards: int

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats of the shard's grams for each text and language, number of characters)."""
        sums, n = np.zeros((len(texts), len(self.models))), np.zeros(len(texts))
        for keys, owner in grams(texts):
            n += np.bincount(owner, minlength=len(texts))
            mine = shard_of(keys, self.shards) == self.number
            keys, owner = keys[mine], owner[mine]
            once, where = np.unique(keys, return_inverse=True)
            for i, m in enumerate(self.models):
                sums[:, i] -= np.bincount(owner, weights=m.log_p(once)[where], minlength=len(texts))
        return sums, n


@dataclass
class Identifier:
    """What turns texts' cross-entropies under the languages' models into languages and scores."""

    langs: list[str]
    #: A score is the softmax of -beta * n^gamma * cross-entropy.
    beta: float = 1.0
    gamma: float = 1.0
    #: Of each language's own documents: mean cross-entropy, spread times sqrt(n), worst distance.
    usual: list[tuple[float, float, float]] = field(default_factory=list)

    def posterior(self, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = -self.beta * np.maximum(n, 1)[:, None] ** self.gamma * ce
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def decide(self, sums: np.ndarray, n: np.ndarray, some: np.ndarray) -> pd.DataFrame:
        """From nats per text and language and numbers of characters; ``some`` texts have a letter."""
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(n), "score": 0.0, "cross_entropy": np.nan, "accepted": False})
        ce = sums / np.maximum(n, 1)[:, None]
        best = ce.argmin(axis=1)
        at = np.arange(len(n))
        mean, spread, worst = (np.array(x)[best] for x in zip(*self.usual))
        far = (ce[at, best] - mean) * np.sqrt(np.maximum(n, 1)) / spread
        return pd.DataFrame({
            "lang_pred": np.where(some, np.array(self.langs, dtype=object)[best], UNKNOWN),
            "score": np.where(some, self.posterior(ce, n)[at, best], 0.0),
            "cross_entropy": np.where(some, ce[at, best], np.nan),
            "accepted": some & (far <= SLACK * worst),
        })

    def calibrate(self, ce: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Fits the score's scale to known documents and notes what is usual."""
        at, best = np.arange(len(truth)), None
        for self.gamma in (0.0, 0.25, 0.5, 0.75, 1.0):
            for self.beta in np.geomspace(0.05, 200, 40):
                loss = -np.log(np.maximum(self.posterior(ce, n)[at, truth], 1e-300)).mean() if len(at) else 0.0
                if best is None or loss < best[0]:
                    best = (loss, self.beta, self.gamma)
        self.beta, self.gamma = best[1:]
        # a language without documents here takes what is usual of all others
        usual = _usual(ce[at, truth], n, (0.0, 1.0, 3.0))
        self.usual = [_usual(ce[truth == i, i], n[truth == i], usual) for i in range(len(self.langs))]


def _usual(x: np.ndarray, n: np.ndarray, otherwise: tuple) -> tuple[float, float, float]:
    """Mean, spread times sqrt(n) and worst distance of cross-entropies."""
    if not len(x):
        return otherwise
    mean, root = float(np.average(x, weights=n)), np.sqrt(n)
    spread = max(1e-3, float(np.sqrt(np.mean(((x - mean) * root) ** 2))))
    return mean, spread, float(np.max((x - mean) * root / spread, initial=3.0))


class Models:
    """All languages' models from (lang, key, n) counts, built shard by shard.

    Spark counts the shorter grams and how many are seen once and twice.  The
    driver holds one shard, of about SHARD_GRAMS grams, and the languages' pairs
    of characters at a time.  No character is coarsened, however many grams there are.
    """

    def __init__(self, counts: DataFrame, name: str):
        self.counts = counts
        seen = [F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")]
        shorter = lambda df, k: df.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << (LANE * k)) - 1)).alias("key")).agg(F.count("*").alias("n"))
        thirds = cut(shorter(counts, 3), name)
        stats = {k: {r["lang"]: r for r in df.groupBy("lang").agg(*seen).collect()} for k, df in ((4, counts), (3, thirds))}
        self.langs = sorted(stats[ORDER])
        self.shards = max(1, math.ceil(sum(r["all"] for r in stats[ORDER].values()) / SHARD_GRAMS)) | 1
        pairs = _by_language(shorter(thirds, 2), self.langs)
        self.whole = [
            Whole({k: discount_of(r[x]["ones"], r[x]["twos"]) for k, r in stats.items()}, tuple(a[np.argsort(pairs[x][0])] for a in pairs[x]))
            for x in self.langs
        ]

    def __iter__(self) -> Iterator[Shard]:
        for s in range(self.shards):
            own = _by_language(self.counts.where(_shard_column(self.shards) == s), self.langs)
            yield Shard([kneser_ney(*own[x], whole) for x, whole in zip(self.langs, self.whole)], s, self.shards)


def _by_language(counts: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    t = counts.select("lang", "key", "n").toArrow()
    lang = t["lang"].combine_chunks().dictionary_encode()
    at = {x: i for i, x in enumerate(lang.dictionary.to_pylist())}
    code, key, n = lang.indices.to_numpy(), t["key"].to_numpy().view(np.uint64), t["n"].to_numpy()
    return {x: (key[code == at.get(x, -1)], n[code == at.get(x, -1)]) for x in langs}


def _sums_of(shared):
    @F.pandas_udf("sums array<double>, n double, some boolean")
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            clean = [letters(t) for t in batch]
            parts = [shared.value.sums(clean[at : at + TEXTS]) for at in range(0, max(1, len(clean)), TEXTS)]
            yield pd.DataFrame({"sums": [row for x, _ in parts for row in x], "n": np.concatenate([n for _, n in parts]), "some": [bool(s) for s in clean]})

    return sums


def fit(labelled: DataFrame) -> tuple[Identifier, Models]:
    """An identifier and its models from (doc_id, lang, text) rows; all of them are counted.

    About CALIBRATION rows, picked by their ids' hash and never more than one of
    APART ids, calibrate scores and rejection.  They are scored by models of
    all rows but them.
    """
    spark = labelled.sparkSession
    every = max(APART, labelled.count() // CALIBRATION)
    some = cut(labelled.where(F.crc32(F.md5(id_key("doc_id"))) % every == 0).limit(2 * CALIBRATION).withColumn("row", F.monotonically_increasing_id()), "calibration")
    exact = count_grams(labelled).withColumn("rest", F.col("n"))
    less = count_grams(some).select("lang", "key", F.lit(0).cast("long").alias("n"), (-F.col("n")).alias("rest"))
    counts = cut(exact.union(less).groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest")), "grams")
    models = Models(counts.select("lang", "key", "n"), "thirds")
    made = Identifier(models.langs)
    if not models.langs:
        return made, models
    rest = Models(counts.where("rest > 0").select("lang", "key", F.col("rest").alias("n")), "thirds-rest")
    sums, n, lang = {}, {}, {}
    for shard in rest:
        shared = spark.sparkContext.broadcast(shard)
        for r in some.select("row", "lang", _sums_of(shared)(body("text")).alias("m")).where("m.n > 0").collect():
            sums[r["row"]] = np.array(r["m"]["sums"]) + sums.get(r["row"], 0.0)
            n[r["row"]], lang[r["row"]] = r["m"]["n"], r["lang"]
        shared.destroy()
    # a language that only the calibration rows have has no other model to be scored by
    known = [i for i in sums if lang[i] in rest.langs]
    ce = np.full((len(known), len(made.langs)), np.inf)
    for j, i in enumerate(known):
        ce[j, [made.langs.index(x) for x in rest.langs]] = sums[i] / n[i]
    made.calibrate(ce, np.array([n[i] for i in known]), np.array([made.langs.index(lang[i]) for i in known], dtype=int))
    return made, models


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning: a fifth of the ids, by CRC-32."""
    return F.crc32(id_key(id_col)) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``language``: struct<lang_pred, score, cross_entropy, accepted>.

    Learns from the rows with a label that are not held out, then scores every
    whole text, once per shard of the models: the language of the lowest cross-entropy per character, the
    calibrated probability that it is right, and whether the text is accepted,
    which it is unless it lies far beyond the calibration documents.

    A null text or one without a letter is ``und`` with score 0, not accepted;
    so is any text if nothing was learned.  Rows that repeat count as often in
    learning and get equal results.  A column named ``language`` is replaced,
    all others stay.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    broadcast = docs.sparkSession.sparkContext.broadcast
    made, models = fit(labelled)
    if models.shards == 1:
        return docs.withColumn("language", _decided(broadcast(made))(_sums_of(broadcast(next(iter(models))))(body(text_col))))
    rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    parts = [cut(rows.select("row", _sums_of(broadcast(s))(body(f"doc.{text_col}")).alias("m")), "sums") for s in models]
    added = F.aggregate(F.collect_list("m.sums"), F.array_repeat(F.lit(0.0), len(made.langs)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    whole = reduce(DataFrame.union, parts).groupBy("row").agg(F.struct(added.alias("sums"), F.first("m.n").alias("n"), F.first("m.some").alias("some")).alias("m"))
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != "language"]
    return rows.join(whole, "row").select(*kept, _decided(broadcast(made))("m").alias("language"))


def _decided(shared):
    @F.pandas_udf("lang_pred string, score double, cross_entropy double, accepted boolean")
    def decided(m: pd.DataFrame) -> pd.DataFrame:
        width = len(shared.value.langs)
        sums = np.array(m["sums"].to_list(), dtype=float).reshape(len(m), width)
        return shared.value.decide(sums, m["n"].to_numpy(), m["some"].to_numpy(dtype=bool))

    return decided
