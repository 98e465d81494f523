"""Substring dedup: recurring passages are confirmed, compiled into sharded
Aho-Corasick automata, and located in the documents."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.bytehash import ByteHasher, joined, split
from cladeloom.llm.common import body, bound_batches
from cladeloom.runtime import cut

WINDOW = 50
#: Words of an anchor phrase.  Every window contains the phrase of the least
#: hash among its WINDOW - ANCHOR + 1 phrases, whichever document it is in.
ANCHOR = 8
#: Words of a seed and the distance between a passage's seeds; with SEED +
#: STRIDE <= WINDOW + 1 every window inside a passage contains a whole seed.
SEED, STRIDE = 16, 35
#: Passage words of one automaton, and document words that one task streams.
SHARD_WORDS, TASK_WORDS = 250_000, 250_000
#: Rows that a task hands on together.
ROWS = 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()


class Windows(ByteHasher):
    """Hashes of a text's windows, and their anchors."""

    def of(self, text: str) -> np.ndarray:
        return self.words(*split(text))

    def anchors(self, words: np.ndarray) -> np.ndarray:
        """For every window the least hash of its phrases."""
        low, width, span = self.runs(words, ANCHOR), 1, WINDOW - ANCHOR + 1
        if len(low) < span:
            return low[:0]
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = span - width
        return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _digest_matches():
    """Whether a text's words have a digest: rows of one id may differ in text."""

    @F.pandas_udf("boolean")
    def matches(texts: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(joined(*split(t))).digest() == d for t, d in zip(texts, digests)], dtype=bool)

    return matches


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is known of each text alone; the anchors of a text too short for a window are none."""
    hasher = Windows()
    for batch in batches:
        n_words, sha, anchors = [], [], []
        for t in batch["text"]:
            cut_up = split(t)
            n_words.append(len(cut_up[1]))
            sha.append(hashlib.sha256(joined(*cut_up)).digest())
            low = hasher.anchors(hasher.words(*cut_up))
            # neighbouring windows mostly share their anchor
            anchors.append(np.unique(low[np.concatenate([[True], low[1:] != low[:-1]])] if len(low) else low).view(np.int64))
        yield pd.DataFrame({"no_id": batch["no_id"], "doc_id": batch["doc_id"], "n_words": n_words, "sha": sha, "anchors": anchors})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w1, w2, doc_id): different windows around each document's recurring anchors."""
    hasher = Windows()
    for batch in batches:
        hashes, ids = [], []
        for doc_id, text, anchors in zip(batch["doc_id"], batch["text"], batch["anchors"]):
            h = hasher.of(text)
            low, known = hasher.anchors(h), np.sort(np.asarray(anchors, dtype=np.int64).view(np.uint64))
            near = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
            w1, w2 = (hasher.runs(h, WINDOW, i)[near] for i in (0, 1))
            order = np.argsort(w1)
            w1, w2 = w1[order], w2[order]
            new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])[: len(w1)]
            hashes.append(np.stack([w1[new], w2[new]]))
            ids.append(np.full(hashes[-1].shape[1], doc_id))
            if sum(map(len, ids)) > ROWS:
                yield _window_rows(hashes, ids)
                hashes, ids = [], []
        if ids:
            yield _window_rows(hashes, ids)


def _window_rows(hashes: list[np.ndarray], ids: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate(hashes, axis=1).view(np.int64)
    return pd.DataFrame({"w1": both[0], "w2": both[1], "doc_id": np.concatenate(ids)})


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(owner, n, passage): runs of words whose windows recur and start here first."""
    hasher = Windows()
    for batch in batches:
        out = []
        for doc_id, text, owned in zip(batch["doc_id"], batch["text"], batch["owned"]):
            words = text.encode().split()  # bytes: ASCII white space only
            w = hasher.runs(hasher.of(text), WINDOW).view(np.int64)
            first = np.zeros(len(w), dtype=bool)
            first[np.unique(w, return_index=True)[1]] = True
            mine = np.flatnonzero(first & np.isin(w, owned))
            for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if len(mine) else []:
                part = words[run[0] : run[-1] + WINDOW]
                out.append((doc_id, len(part), b" ".join(part).decode()))
        yield pd.DataFrame(out, columns=["owner", "n", "passage"])


def automaton(passages: list[list[str]]) -> ahocorasick.Automaton:
    """Seeds of all passages, each with its places."""
    places: dict[str, list[tuple[int, int]]] = {}
    for i, words in enumerate(passages):
        for q in range(0, len(words) - SEED + 1, STRIDE):
            places.setdefault(f" {' '.join(words[q : q + SEED])} ", []).append((i, q))
    made = ahocorasick.Automaton()
    for seed, where in places.items():
        made.add_word(seed, where)
    made.make_automaton()
    return made


def occurrences(text: str, doc_id: int, made, passages: list[list[str]], owners: list[int]) -> list[tuple[int, int]]:
    """Word intervals of ``text`` that repeat WINDOW or more words of an earlier owner's passage."""
    words, found, reached = text.split(" "), [], {}
    ends, at = [], 1
    for w in words:
        at += len(w) + 1
        ends.append(at - 1)
    for end, where in made.iter(f" {text} "):
        p = bisect_left(ends, end) - SEED + 1
        for i, q in where:
            if owners[i] >= doc_id or reached.get((i, p - q), -1) > p:
                continue
            own, a, b, x = passages[i], p, p + SEED, q
            while a and x and words[a - 1] == own[x - 1]:
                a, x = a - 1, x - 1
            y = q + SEED
            while b < len(words) and y < len(own) and words[b] == own[y]:
                b, y = b + 1, y + 1
            reached[i, p - q] = b
            if b - a >= WINDOW:
                found.append((a, b))
    return found


def _locate(passages: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    own = [p.split(" ") for p in passages["passage"]]
    owners, out = passages["owner"].tolist(), []
    if len(own):
        made = automaton(own)
        for sha, doc_id, text in zip(docs["sha"], docs["doc_id"], docs["text"]):
            plain = joined(*split(text)).decode()
            out += [(sha, a, b) for a, b in set(occurrences(plain, doc_id, made, own, owners))]
    return pd.DataFrame(out, columns=["sha", "a", "b"])


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for sha, text, starts, ends in zip(batch["sha"], batch["text"], batch["starts"], batch["ends"]):
            cut_up = split(text)
            edge = np.zeros(len(cut_up[1]) + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows.append((sha, int(gone.sum()), joined(*cut_up, ~gone).decode()))
        yield pd.DataFrame(rows, columns=["sha", "n_removed", "kept_text"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, changed): what is left of every row, and the texts that changed.

    ``rows``: (doc_id, n_words, n_removed, kept_sha256), one row per input row.
    A word is removed if a window of WINDOW words covers it whose words also
    start in a row of a smaller id; windows are judged on the input.
    ``changed``: (sha, n_removed, kept_text) per distinct text that loses some
    words without being a copy of an earlier text; ``sha`` is the SHA-256 of its
    words joined by one space.

    1. Texts of equal words are one; a copy of an earlier one loses all words.
    2. Each text gives its anchors (about one phrase in twenty).  Those that
       start in two ids mark texts and windows that may recur.
    3. The windows around such anchors, by 128-bit hashes, are grouped: the
       smallest id is the window's owner.  Owned windows join into passages.
    4. Passages are dealt to shards by owner.  A text is streamed through the
       automata of those shards that own one of its windows; seed hits extend
       word by word, so only true repeats count.  Shards that many texts need
       are repeated, so that no task streams more than a bounded part.

    Whole texts are shuffled once; later steps see the recurring ones only.
    Null and empty texts have no words.  A row with a null id loses nothing and
    no other row loses on its account; rows that repeat an id are not earlier
    than each other.  Other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    text, number = body(text_col), F.col(id_col)
    # pandas would turn a null number into a float: nulls travel as a flag
    given = docs.select(
        number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).cast("bigint").alias("doc_id"), text.alias("text")
    )
    summaries = cut(
        given.mapInPandas(_summaries, "no_id boolean, doc_id long, n_words long, sha binary, anchors array<long>"),
        "passage-rows",
    )
    known = summaries.where("not no_id")
    texts = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    # a copy of a text says nothing new: only the first id of each text counts
    anchors = known.join(texts, ["sha", "doc_id"], "left_semi").select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    marked = (
        anchors.join(recurring.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    )
    here = given.where("not no_id").select("doc_id", "text")
    held = cut(texts.join(marked, "doc_id").join(here, "doc_id").where(_digest_matches()("text", "sha")), "passage-texts")

    windows = cut(held.select("doc_id", "text", "anchors").mapInPandas(_windows, "w1 long, w2 long, doc_id long"), "windows")
    shared = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    shared = cut(shared.select("w1", "w2", "owner"), "shared-windows")
    owned = shared.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("w1").alias("owned"))
    passages = cut(
        held.select("doc_id", "text").join(owned, "doc_id").mapInPandas(_passages, "owner long, n long, passage string"),
        "passages",
    )
    words = passages.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(words / SHARD_WORDS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    routes = (
        windows.join(shared, ["w1", "w2"]).where("owner < doc_id").select("doc_id", shard("owner").alias("shard")).distinct()
    )
    sized = cut(routes.join(held.select("doc_id", F.size(F.split("text", " ")).alias("n")), "doc_id"), "routes")
    rounds = sized.groupBy("shard").agg(F.ceil(F.sum("n") / TASK_WORDS).cast("int").alias("rounds"))
    routed = (
        sized.select("doc_id", "shard").distinct().join(rounds, "shard")
        .select("doc_id", "shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), "rounds").alias("round"))
        .join(held.select("doc_id", "sha", "text"), "doc_id")
    )
    dealt = passages.withColumn("shard", shard("owner")).join(rounds, "shard").select(
        "shard", "owner", "passage", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round")
    ).select("shard", F.col("round").cast("long").alias("round"), "owner", "passage")
    located = (
        dealt.groupBy("shard", "round")
        .cogroup(routed.select("shard", F.col("round").cast("long").alias("round"), "sha", "doc_id", "text").groupBy("shard", "round"))
        .applyInPandas(_locate, "sha binary, a long, b long")
    )
    spans = located.groupBy("sha").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    changed = cut(
        held.select("sha", "text").join(spans, "sha").mapInPandas(_rewritten, "sha binary, n_removed long, kept_text string")
        .dropDuplicates(["sha"]),
        "kept-texts",
    )
    # written, so that a text with very many copies can be split in the join with its rows
    outcome = cut(
        texts.withColumnRenamed("doc_id", "first").join(
            changed.select("sha", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), "sha", "left"
        ),
        "passage-outcome",
    )
    gone = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    mine = F.col("doc_id") == F.col("first")
    lost = F.when(F.col("no_id"), 0).when(gone, F.col("n_words")).when(mine & F.col("n_removed").isNotNull(), F.col("n_removed")).otherwise(0)
    kept = F.when(F.col("no_id"), F.lower(F.hex("sha"))).when(gone, EMPTY).when(mine & F.col("kept_sha256").isNotNull(), F.col("kept_sha256")).otherwise(F.lower(F.hex("sha")))
    rows = summaries.drop("anchors").join(outcome, "sha", "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words",
        lost.cast("bigint").alias("n_removed"), kept.alias("kept_sha256"),
    )
    return rows, changed
