"""SimHash near-dedup: fingerprints, vantage-point shards, exact pairs, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body, bound_batches
from cladeloom.runtime import cut

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that the shards' tree is fitted on, at most.  It decides how
#: even the shards are, never which pairs are found.
SAMPLE = 20_000
#: Fingerprints that a shard should hold at most, and a leaf inside a task.
SHARD_ROWS, LEAF = 250_000, 512
#: Leaves that no vantage point splits are compared in full up to this size;
#: beyond it the neighbours of each fingerprint are looked up.
COMPARE = 1 << 16
#: Shingles whose bits are counted together.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: each is set if over half of the shingles' XXH64 have it set."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    k = min(shingle, len(words))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        h = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(ends[at:stop], ends[at + k : stop + k])])
        ones += np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint_column(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch), dtype=np.uint64, count=len(batch))
            yield pd.Series(fps.view(np.int64))

    return fingerprints


# A vantage-point tree: a leaf is None, a node (pivot, radius, inside, outside).
# Inside lies what is at most ``radius`` from the pivot, outside what is more
# than ``radius - reach`` from it.  By the triangle inequality two fingerprints
# within ``reach`` of each other share a side, so every pair meets in a leaf.


def distances(fps: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(pivot))


def vantage(fps: np.ndarray, reach: int) -> tuple[int, int] | None:
    """The pivot and radius that leave the least to compare; None if no split helps."""
    n, best = len(fps), None
    for pivot in fps[:: max(1, n // 8)]:
        upto = np.cumsum(np.bincount(distances(fps, pivot), minlength=65))
        inside = upto[:64]
        outside = n - np.concatenate([np.zeros(reach, dtype=upto.dtype), upto])[:64]
        cost = inside.astype(float) ** 2 + outside.astype(float) ** 2
        radius = int(cost.argmin())
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], int(pivot), radius)
    return best[1:] if best and best[0] < 0.9 * float(n) ** 2 else None


def sides(fps: np.ndarray, pivot: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    d = distances(fps, pivot).astype(np.int64)
    return d <= radius, d > radius - reach


def grow(fps: np.ndarray, depth: int, reach: int):
    """A tree of up to 2^depth leaves fitted to a sample."""
    split = vantage(fps, reach) if depth and len(fps) > 1 else None
    if split is None:
        return None
    near, far = sides(fps, *split, reach)
    return (*split, grow(fps[near], depth - 1, reach), grow(fps[far], depth - 1, reach))


def route(fps: np.ndarray, tree, reach: int, shard: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fingerprints) for every leaf that one of the fingerprints reaches."""
    if not len(fps):
        return
    if tree is None:
        yield shard, fps
        return
    pivot, radius, inside, outside = tree
    near, far = sides(fps, pivot, radius, reach)
    yield from route(fps[near], inside, reach, 2 * shard)
    yield from route(fps[far], outside, reach, 2 * shard + 1)


def _settle(labels: np.ndarray, lowest) -> np.ndarray:
    """Lowers labels to those of neighbours until each component has one."""
    while True:
        new = np.minimum(labels, lowest(labels))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _leaf_labels(fps: np.ndarray, reach: int) -> np.ndarray:
    """For each fingerprint the place of the first one of its component."""
    n = len(fps)
    labels = np.arange(n)
    if n <= COMPARE:
        rows = max(1, (1 << 20) // n)

        def lowest(now):
            out = now.copy()
            for at in range(0, n, rows):
                close = np.bitwise_count(fps[at : at + rows, None] ^ fps[None, :]) <= reach
                out[at : at + rows] = np.where(close, now[None, :], n).min(axis=1)
            return out

        return _settle(labels, lowest)
    masks = [sum(1 << b for b in bits) for k in range(1, reach + 1) for bits in combinations(range(64), k)]

    def lookup(now):
        out = now.copy()
        for mask in masks:
            wanted = fps ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(fps, wanted), n - 1)
            found = fps[at] == wanted
            out[found] = np.minimum(out[found], now[at[found]])
        return out

    return _settle(labels, lookup)


def links(fps: np.ndarray, reach: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, root) links that join all pairs within ``reach`` among sorted distinct ``fps``."""
    split = vantage(fps, reach) if len(fps) > LEAF else None
    if split is None:
        labels = _leaf_labels(fps, reach)
        linked = labels != np.arange(len(fps))
        yield fps[linked], fps[labels[linked]]
        return
    near, far = sides(fps, *split, reach)
    yield from links(fps[near], reach)
    yield from links(fps[far], reach)


def near_links(fps: DataFrame, reach: int = RADIUS) -> DataFrame:
    """(a, b) links between the distinct values of ``fps.fp`` that give its components.

    Any two fingerprints within ``reach`` bits are joined by a path of links.  A
    tree fitted to a bounded sample deals all fingerprints out to shards, those
    near a boundary to both sides; each shard goes on splitting in its task and
    compares what is left in its leaves.  A shard holds distinct fingerprints
    only and returns a link per member, never a group's pairs.
    """
    spark = fps.sparkSession
    n = fps.count()
    every = max(1, n // SAMPLE)
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64)).view(np.uint64)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = math.ceil(math.log2(max(2, 4 * parts, n / SHARD_ROWS)))
    tree = grow(np.sort(sample), depth, reach)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, mine in route(batch["fp"].to_numpy(np.int64).view(np.uint64), tree, reach):
                yield pd.DataFrame({"shard": shard, "fp": mine.view(np.int64)})

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(shard["fp"].to_numpy(np.int64).view(np.uint64))
        found = list(links(own, reach))
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    dealt = fps.mapInPandas(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) edges reaches.

    Rounds of large and small stars: every node's neighbours move to the
    smallest one.  Hubs are reduced by an aggregate and joined back, so no
    neighbourhood is gathered; each round is a written table.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        """(a, b) with b < a; a moves to the least of b and b's least neighbour."""
        both = e if small else e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
        least = least.select("hub", F.least("hub", "m").alias("m"))
        moved = both.join(least, F.col("a") == F.col("hub")).where(F.lit(small) | (F.col("b") > F.col("hub")))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionAll(least.select(F.col("hub").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges = cut(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        edges = cut(star(star(edges, small=False), small=True), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(20)))")).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, fp): the input row as a struct, and its fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), fingerprint_column(shingle)(body(text_col)).alias("fp"))


def group_fingerprints(rows: DataFrame, reach: int = RADIUS) -> DataFrame:
    """(fp, component_id, keep_fp) per distinct fingerprint of (doc_id, fp) rows.

    ``component_id`` is the smallest id that the fingerprint reaches, null only
    if there is none; ``keep_fp`` the fingerprint of the row to keep, which is
    the one of that id (the least if it has several, or if there is no id).
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(near_links(distinct.select("fp"), reach))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("best")
    least = rooted.groupBy("root").agg(best)
    return rooted.join(least, "root").select(
        "fp", F.col("best.first").alias("component_id"), F.col("best.fp").alias("keep_fp")
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, reach: int = RADIUS
) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    ``fp`` is the fingerprint as a signed long; ``component_id`` the smallest id
    among all rows whose fingerprints are linked, directly or by others, at
    ``reach`` or fewer differing bits.  Equal fingerprints are compared once and
    joined back to their rows, however many there are.

    Null and empty texts have fingerprint zero and are linked like any other;
    rows that repeat are in one component; null ids count only if a component
    has no other (its id is then null).  Other columns are ignored; an empty
    table gives no rows.
    """
    rows = cut(with_fingerprint(docs, text_col, shingle).select(F.col("row")[id_col].alias("doc_id"), "fp"), "simhash")
    of = cut(group_fingerprints(rows, reach), "components")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, reach: int = RADIUS
) -> DataFrame:
    """``docs`` with one row of each component of ``near_groups``: that of the smallest id.

    A row without an id stays only if its component has no id.  Of rows that
    agree in id and fingerprint the least one stays, which each task picks out of
    its own before they meet.
    """
    rows = with_fingerprint(docs, text_col, shingle).select("row", "fp", F.col("row")[id_col].alias("doc_id"))
    narrow = cut(rows.select("doc_id", "fp"), "simhash")
    kept = group_fingerprints(narrow, reach).where("fp = keep_fp").select("fp", F.col("component_id").alias("doc_id"))
    known = lambda df: df.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}).drop("doc_id")
    chosen = known(rows).join(known(kept), ["fp", "id", "no_id"])
    return chosen.groupBy("fp", "id", "no_id").agg(F.min("row").alias("row")).select("row.*")
