"""MinHash near-dedup by HyperMinHash registers: bands propose, corrected estimates thin out, full sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeloom.llm.bytehash import ByteHasher, split
from cladeloom.llm.common import body, bound_batches
from cladeloom.llm.simhash import components
from cladeloom.runtime import cut

SHINGLE, PERCENT = 3, 85
#: Bands of BAND_ROWS registers.  A pair of similarity 0.8 misses all bands with
#: probability (1 - 0.8 ** 5) ** 40 = 1e-7, one of 0.85 with 7e-11.
BANDS, BAND_ROWS = 40, 5
#: A register holds the leading zeros of a 32-bit minimum (6 bits) and the bits after its first one.
MANTISSA = 10
#: An estimate this many standard deviations below the threshold is still verified.
DEVIATIONS = 6.0
#: Shingles that are hashed together, and hashes that travel in one row.
CHUNK, PACK = 1 << 12, 1 << 12
_R = BANDS * BAND_ROWS
_SALT, _MUL, _MUL2 = np.random.default_rng(11).integers(1, 1 << 31, (3, _R, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: The constant of the HyperMinHash paper (Yu and Weber): a register of two
#: unrelated sets of one size collides with probability 2 * this / 2^MANTISSA.
COLLISION = 0.169919487159739


def shingles(text: str, k: int = SHINGLE) -> set[bytes]:
    """The different runs of ``k`` words, or all words of a shorter text; ASCII letters in either case."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingle_hashes(text: str, k: int, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each different shingle."""
    data, starts, ends = split(text)
    upper = (data >= 65) & (data <= 90)
    words = hasher.words(np.where(upper, data + np.uint8(32), data), starts, ends)
    k = max(1, min(k, len(words)))
    h, at = np.unique(hasher.runs(words, k), return_index=True)
    return h, hasher.runs(words, k, 1)[at]


def registers(h: np.ndarray) -> np.ndarray:
    """One register per hash function: leading zeros and mantissa of the least value."""
    least = np.full(_R, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), CHUNK):
        x = (short[None, at : at + CHUNK] ^ _SALT) * _MUL
        x ^= x >> np.uint32(15)
        x *= _MUL2
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    length = np.frexp(least.astype(np.float64))[1]  # bits up to the first one
    shift = np.maximum(length - 1 - MANTISSA, 0)
    mantissa = (least >> shift.astype(np.uint32)) & np.uint32((1 << MANTISSA) - 1)
    return ((32 - length) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)


def corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from counts of equal registers, less those that unrelated minima share."""
    ratio = n / m
    chance = 2 * COLLISION / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, (equal / _R - chance) / (1 - chance))


def _sketched(k: int):
    @F.pandas_udf("skey binary, n long, registers binary")
    def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        for batch in texts:
            rows = []
            for t in batch:
                h, g = shingle_hashes(t, k, hasher)
                lanes = np.array([len(h), h.sum(dtype=np.uint64), g.sum(dtype=np.uint64)], dtype=np.uint64)
                rows.append((lanes.tobytes(), len(h), registers(h).tobytes() if len(h) else b""))
            yield pd.DataFrame(rows, columns=["skey", "n", "registers"])

    return sketched


def _may_link(percent: int):
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / _R) ** 0.5

    @F.pandas_udf(T.BooleanType())
    def may_link(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, _R) for s in (a, b))
        return pd.Series(corrected((x == y).sum(axis=1), n.to_numpy(), m.to_numpy()) >= least)

    return may_link


def _linked(k: int, percent: int):
    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, known = [], None, set()
        for x, y in zip(a, b):
            if y != last:
                last, known = y, shingles(y, k)
            other = shingles(x, k)
            both = len(other & known)
            out.append(100 * both >= percent * (len(other) + len(known) - both))
        return pd.Series(out, dtype=bool)

    return linked


def _packs(k: int):
    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ByteHasher()
        for batch in batches:
            own, packed = [], []
            for key, text in zip(batch["skey"], batch["text"]):
                h = shingle_hashes(text, k, hasher)[0].view(np.int64)
                for at in range(0, len(h), PACK):
                    own.append(key)
                    packed.append(h[at : at + PACK])
            yield pd.DataFrame({"skey": pd.Series(own, dtype=object), "packed": pd.Series(packed, dtype=object)})

    return packs


def similar_sets(
    sets: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT, proposed: DataFrame | None = None
) -> DataFrame:
    """(node, root) of the sets that are linked to another one.

    ``sets`` is (skey, tkey, n, registers), each skey once; ``texts`` is (tkey,
    text), repeats allowed.  In every bucket all members are compared with its
    leader, the member that shares the most with others.  Where buckets still
    hold several components, pairs across them follow, but only those that can
    reach the threshold: with shingles in the order of their rarity among the
    sets of such buckets, linked sets share one of their first n - t n + 1, and
    behind it enough is left of both.  This loses no pair.  Pairs inside a
    component need no look, as it is joined anyhow.
    ``proposed`` pairs (a, b, n_a, n_b) of skeys from elsewhere are verified first.
    """
    close = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    band = lambda i: F.xxhash64(F.lit(i), F.substring("registers", 2 * BAND_ROWS * i + 1, 2 * BAND_ROWS))
    dealt = sets.select("skey", "n", F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"))
    crowded = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(dealt.join(crowded, "bucket"), "members")
    weights = members.groupBy("skey").agg(F.sum("size").alias("weight"))
    members = cut(members.drop("size").join(weights, "skey"), "weighted-members")
    held = texts.join(sets.select("tkey", "skey").join(weights.select("skey"), "skey", "left_semi"), "tkey")
    held = cut(held.groupBy("skey").agg(F.min("text").alias("text")), "member-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b, n_a, n_b) that are linked."""
        left, right = (sets.select(F.col("skey").alias(c), F.col("registers").alias(f"reg_{c}")) for c in "ab")
        near = pairs.join(left, "a").join(right, "b").where(_may_link(percent)("reg_a", "reg_b", "n_a", "n_b"))
        near = cut(near.select("a", "b"), "near-pairs")
        left, right = (held.select(F.col("skey").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = near.join(left, "a").join(right, "b")
        return cut(both.where(_linked(k, percent)("text_a", "text_b")).select("a", "b"), "linked-pairs")

    root = F.coalesce("root", "skey").alias("root")
    links = None
    if proposed is not None:
        links = verified(proposed.where(close(F.col("n_a"), F.col("n_b"))))
        roots = components(links)
        members = cut(members.join(roots, F.col("skey") == F.col("node"), "left").select(*members.columns, root), "rooted")
    else:
        members = members.withColumn("root", F.col("skey"))
    leader = F.max(F.struct("weight", "skey", "n", "root")).alias("leader")
    led = members.join(members.groupBy("bucket").agg(leader), "bucket").where("root != leader.root")
    to_leader = led.select(
        F.col("skey").alias("a"), F.col("leader.skey").alias("b"), F.col("n").alias("n_a"), F.col("leader.n").alias("n_b")
    ).where(close(F.col("n_a"), F.col("n_b")))
    led = verified(to_leader.distinct())
    links = led if links is None else cut(links.unionAll(led), "links")
    roots = cut(components(links), "roots")
    members = members.drop("root")
    rooted = cut(members.join(roots, F.col("skey") == F.col("node"), "left").select("bucket", "skey", "n", root), "rooted")
    contested = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    open_ = cut(rooted.join(contested.select("bucket"), "bucket"), "contested")

    # of each contested set the rarest shingles: two linked sets share one of them, and not too late in both
    packs = held.join(open_.select("skey").distinct(), "skey", "left_semi").mapInPandas(_packs(k), "skey binary, packed array<long>")
    single = cut(packs, "contested-shingles").select("skey", F.explode("packed").alias("h"))
    known = single.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("skey")
    ranked = single.join(known, "h").select(
        "skey", "h", F.row_number().over(own.orderBy("df", "h")).alias("rank"), F.count(F.lit(1)).over(own).alias("common")
    )
    facts = open_.groupBy("skey").agg(F.min("n").alias("n"), F.min("root").alias("root"))
    place = F.col("n") - F.col("common") + F.col("rank")  # from 1; shingles of no other set come first
    early = ranked.join(facts, "skey").select("h", "skey", "n", "root", place.alias("place")).where(
        percent * F.col("n") <= 100 * (F.col("n") - F.col("place") + 1)
    )
    early = cut(early, "rare-shingles")
    parted = early.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("h")
    early = early.join(parted, "h")
    side = lambda c: early.select("h", *[F.col(x).alias(f"{x}_{c}") for x in ("skey", "n", "root", "place")])
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    across = side("a").join(side("b"), "h").where(
        (F.col("root_a") < F.col("root_b")) & close(F.col("n_a"), F.col("n_b")) & ((100 + percent) * rest >= percent * (F.col("n_a") + F.col("n_b")))
    ).select("skey_a", "skey_b", "n_a", "n_b").distinct()
    more = verified(across.select(F.col("skey_a").alias("a"), F.col("skey_b").alias("b"), "n_a", "n_b"))
    return roots if more.isEmpty() else components(links.unionAll(more))


def similar_texts(
    docs: DataFrame, id_col: str, text_col: str, k: int, percent: int,
    mark: Callable[[Column], Column] | None = None, propose: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (doc_id, tkey, skey, n) per row, and (skey, root, first) per distinct set.

    ``tkey`` is the MD5 of the text, ``skey`` a 128-bit key of its set of
    shingles; ``first`` a struct (no_id, doc_id, tkey) of the set's row with the
    smallest id.  Texts without words are one set, which is linked with no other.
    ``mark`` gives a further column of each text, and ``propose`` pairs of sets
    from the distinct sets (skey, n, mark), which are verified before others.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(body(text_col))).alias("tkey"), body(text_col).alias("text"))
    marked = (mark(F.col("text")) if mark else F.lit(None).cast("bigint")).alias("mark")
    rows = given.select("doc_id", "tkey", _sketched(k)("text").alias("s"), marked).select("doc_id", "tkey", "s.*", "mark")
    rows = cut(rows, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first")
    sets = cut(rows.groupBy("skey").agg(first, F.min("n").alias("n"), F.min("registers").alias("registers"), F.min("mark").alias("mark")), "sets")
    some = sets.where("n > 0").select("skey", "n", "registers", "mark", "first.tkey")
    roots = similar_sets(some, given.select("tkey", "text"), k, percent, propose(some) if propose else None)
    groups = sets.join(roots, F.col("skey") == F.col("node"), "left").select("skey", F.coalesce("root", "skey").alias("root"), "first")
    return rows.drop("registers", "mark"), cut(groups, "groups")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    A document's set holds its different runs of ``k`` words (all words of a
    shorter text); two documents are linked if 100 times what their sets share
    is ``percent`` times their union or more.  ``component_id`` is the smallest
    id among all rows that links reach, ``kept`` whether it is the row's own.

    Null and empty texts have no shingles and are linked with nothing: each such
    row is its own component.  Rows that repeat share a component and are all
    kept or not; a null id counts only where a component has no other, and is
    never kept.  Other columns are ignored; an empty table gives no rows.
    """
    rows, groups = similar_texts(docs, id_col, text_col, k, percent)
    smallest = groups.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of = cut(groups.join(smallest, "root").select("skey", "component_id"), "components")
    found = rows.join(of, "skey", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT,
    mark: Callable[[Column], Column] | None = None, propose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Null and empty texts are one group here.  A row without an id stays only if
    its group has no id.  Of rows that agree in id and text the least one stays.
    """
    _, groups = similar_texts(docs, id_col, text_col, k, percent, mark, propose)
    best = groups.groupBy("root").agg(F.min("first").alias("best")).select("best.tkey", "best.doc_id")
    known = lambda df: df.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}).drop("doc_id")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(body(text_col))).alias("tkey"), F.col(id_col).alias("doc_id"))
    chosen = known(rows).join(known(cut(best, "kept")), ["tkey", "id", "no_id"])
    return chosen.groupBy("tkey", "id", "no_id").agg(F.min("row").alias("row")).select("row.*")
