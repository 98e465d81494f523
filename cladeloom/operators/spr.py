"""Subtree-prune-and-regraft moves: enumeration, exact scores, application.

A move cuts the subtree at ``src`` and hangs it on the edge above ``dst``.  Its
score is the change in Fitch cost (reference edge included).  Scores come from
replaying only what changes: each (move, word) starts with two changed children,
one below the old parent of ``src`` and one below the parent of ``dst``, and a
changed base set climbs one level per round until it stops changing.  All moves
of all trees climb together, one join and one aggregate per depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions import sitewords as sw
from cladeloom.operators import fitch
from cladeloom.runtime import cut
from cladeloom.schema import GENOME, HistoryDag

ALL_BITS = 2 ** (4 * sw.SITES) - 1


def _not(c: Column) -> Column:
    return F.lit(ALL_BITS).cast("bigint").bitwiseAND(F.bitwise_not(c))


@dataclass(frozen=True)
class TreeIndex:
    """nodes: keys, node_id, parent_id, depth, n_children;
    sets: (keys, node_id, word, bits, ref) of every node;
    kids: per inner node and word, which bases all / all but one / all but two /
    any / exactly one / exactly two of its children have."""

    tree: fitch.Tree
    sets: DataFrame
    kids: DataFrame

    @property
    def keys(self) -> list[str]:
        return list(self.tree.keys)


def child_profiles(tree: fitch.Tree, sets: DataFrame) -> DataFrame:
    keys = list(tree.keys)
    up = tree.nodes.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", "parent_id")
    size = tree.nodes.where("n_children > 0").select(
        *keys, F.col("node_id").alias("parent_id"), F.col("n_children").alias("n")
    )
    by = [*keys, "parent_id", "word", "n"]
    rows = sets.join(up, [*keys, "node_id"]).join(size, [*keys, "parent_id"]).select(*by, "bits")
    small = rows.where("n <= 2").groupBy(*by).agg(
        F.bit_and("bits").alias("all_"), F.bit_or("bits").alias("any_"), F.bit_xor("bits").alias("one")
    )
    pair = F.col("n") == 2
    small = small.select(
        *by, "all_",
        F.when(pair, F.col("one")).otherwise(_not(F.col("all_"))).alias("miss1"),
        F.when(pair, _not(F.col("any_"))).otherwise(0).cast("bigint").alias("miss2"),
        "any_", "one", F.when(pair, F.col("all_")).otherwise(0).cast("bigint").alias("two"),
    )
    # Larger families count children per base: one row per base a child can have.
    bit = F.explode(F.sequence(F.lit(0), F.lit(4 * sw.SITES - 1))).alias("bit")
    held = rows.where("n > 2").select(*by, "bits", bit)
    held = held.where(F.call_function("shiftright", "bits", "bit").bitwiseAND(F.lit(1).cast("bigint")) == 1)
    counts = held.groupBy(*by, "bit").agg(F.count(F.lit(1)).alias("c"))
    spot = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))

    def where_count(cond):
        return F.bit_or(F.when(cond, spot).otherwise(F.lit(0).cast("bigint")))

    n, c = F.col("n"), F.col("c")
    large = counts.groupBy(*by).agg(
        where_count(c == n).alias("all_"), where_count(c == n - 1).alias("miss1"),
        where_count(c == n - 2).alias("miss2"), where_count(c > 0).alias("any_"),
        where_count(c == 1).alias("one"), where_count(c == 2).alias("two"),
    )
    return small.unionByName(large).withColumnRenamed("parent_id", "node_id")


def index_tree(tree: fitch.Tree, leaf_words: DataFrame) -> TreeIndex:
    """Search index from dense leaf words (every word of every leaf)."""
    sets = fitch.sets_up(tree, leaf_words, dense=True)
    inner = sets.inner.select(*tree.keys, "node_id", "word", F.col("set").alias("bits"), "ref")
    tips = leaf_words.select(*tree.keys, "node_id", "word", "bits", "ref")
    every = cut(inner.unionByName(tips), "sets")
    return TreeIndex(tree, every, cut(child_profiles(tree, every), "kids"))


def index_dag(dag: HistoryDag) -> TreeIndex:
    """Search index of every tree in the container."""
    tree, _, _, words = fitch.prepare(dag, dense=True)
    return index_tree(tree, words)


def tree_cost(index: TreeIndex) -> DataFrame:
    """(keys, cost): (node, site) pairs without a common base, reference edge left out."""
    clash = F.when(F.col("n") > 1, sw.empty_sites(F.col("all_"), F.col("any_"))).otherwise(0)
    if not index.keys:
        return index.kids.agg(F.sum(clash).cast("bigint").alias("cost"))
    return index.kids.groupBy(*index.keys).agg(F.sum(clash).cast("bigint").alias("cost"))


def searchable(index: TreeIndex) -> DataFrame:
    """Nodes worth moving: all but the root and repeats of an identical sibling leaf."""
    keys = index.keys
    body = index.tree.nodes.where(F.col("parent_id").isNotNull())
    inner = body.where("n_children > 0").select(*keys, "node_id")
    leaves = body.where("n_children = 0").select(*keys, "node_id", "parent_id")
    genome = index.sets.join(leaves, [*keys, "node_id"]).groupBy(*keys, "parent_id", "node_id").agg(
        F.bit_xor(F.xxhash64("word", "bits")).alias("h1"),
        F.bit_xor(F.xxhash64("bits", "word", F.lit(1))).alias("h2"),
    )
    first = genome.groupBy(*keys, "parent_id", "h1", "h2").agg(F.min("node_id").alias("node_id"))
    return inner.unionByName(first.select(*keys, "node_id"))


def paths_up(tree: fitch.Tree, radius: int) -> DataFrame:
    """(keys, node_id, anc, via, up): ancestors within ``radius``; ``via`` is the
    ancestor's child on the way."""
    keys = list(tree.keys)
    link = tree.nodes.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", "parent_id")
    step = link.select(*keys, "node_id", F.col("parent_id").alias("anc"), F.col("node_id").alias("via"))
    parts = step.withColumn("up", F.lit(1))
    hop = link.select(*keys, F.col("node_id").alias("anc"), F.col("parent_id").alias("next"))
    for k in range(2, radius + 1):
        step = step.join(hop, [*keys, "anc"]).select(
            *keys, "node_id", F.col("next").alias("anc"), F.col("anc").alias("via")
        )
        parts = parts.unionByName(step.withColumn("up", F.lit(k)))
    return parts


def candidate_moves(
    index: TreeIndex, radius: int, sources: DataFrame | None = None, siblings: bool = True
) -> DataFrame:
    """(keys, src, dst, lca): every regraft within ``radius``.

    A source climbs k <= radius levels, then goes down the other children at
    most radius - k levels further.  ``siblings=False`` leaves out regrafts onto
    a sibling.
    """
    keys = index.keys
    paths = cut(paths_up(index.tree, radius), "paths")
    sources = searchable(index) if sources is None else sources
    src = paths.join(sources, [*keys, "node_id"], "left_semi").select(
        *keys, F.col("node_id").alias("src"), "anc", F.col("via").alias("src_via"), F.col("up").alias("k")
    )
    dst = paths.select(
        *keys, F.col("node_id").alias("dst"), "anc", F.col("via").alias("dst_via"), F.col("up").alias("j")
    )
    if siblings:
        pairs = src.join(dst, [*keys, "anc"])
    else:
        near = src.where("k = 1").join(dst.where("j > 1"), [*keys, "anc"])
        pairs = near.unionByName(src.where("k > 1").join(dst, [*keys, "anc"]))
    return pairs.where(
        (F.col("src_via") != F.col("dst_via")) & (F.col("j") <= radius - F.col("k") + 1)
    ).select(*keys, "src", "dst", F.col("anc").alias("lca"))


def _changed(rows: DataFrame) -> DataFrame:
    """New set and cost of a node some of whose children changed."""
    c = rows
    both, either = F.col("old_and"), F.col("old_or")
    single = F.col("k") == 1
    split = either.bitwiseAND(_not(both))
    rest_all_1 = F.col("all_").bitwiseOR(F.col("miss1").bitwiseAND(_not(both)))
    rest_all_2 = (
        F.col("all_").bitwiseAND(both)
        .bitwiseOR(F.col("miss1").bitwiseAND(split))
        .bitwiseOR(F.col("miss2").bitwiseAND(_not(either)))
    )
    rest_any = F.col("any_").bitwiseAND(_not(F.col("one").bitwiseAND(either)))
    rest_any_2 = rest_any.bitwiseAND(_not(F.col("two").bitwiseAND(both)))
    c = c.select(
        "*",
        F.when(single, rest_all_1).otherwise(rest_all_2).alias("rest_all"),
        F.when(single, rest_any).otherwise(rest_any_2).alias("rest_any"),
    )
    full = F.lit(ALL_BITS).cast("bigint")
    c = c.select(
        "*",
        F.col("rest_all").bitwiseAND(F.coalesce("new_and", full)).alias("now_all"),
        F.col("rest_any").bitwiseOR(F.coalesce("new_or", F.lit(0).cast("bigint"))).alias("now_any"),
    )
    was = F.when(F.col("n") > 1, sw.empty_sites(F.col("all_"), F.col("any_"))).otherwise(0)
    now = F.when(F.col("n") - F.col("gone") > 1, sw.empty_sites(F.col("now_all"), F.col("now_any"))).otherwise(0)
    return c.withColumn("set_now", sw.fitch_set(F.col("now_all"), F.col("now_any"))).withColumn(
        "delta", (now - was).cast("bigint")
    )


def score_moves(index: TreeIndex, moves: DataFrame) -> DataFrame:
    """Moves with ``score``, the exact change in Fitch cost.

    ``dst`` must lie outside the subtree of ``src`` and not above it.  Moves
    that would leave a node without children are dropped.
    """
    keys = index.keys
    moves = cut(moves, "moves")
    node = index.tree.nodes
    bits = index.sets.select(*keys, "node_id", "word", "bits")
    src_at = node.select(
        *keys, F.col("node_id").alias("src"), F.col("parent_id").alias("src_parent"),
    )
    src_parent = node.select(
        *keys, F.col("node_id").alias("src_parent"), F.col("depth").alias("src_depth"),
        F.col("n_children").alias("src_n"),
    )
    dst_at = node.select(
        *keys, F.col("node_id").alias("dst"), F.col("parent_id").alias("dst_parent"),
        (F.col("depth") - 1).alias("dst_depth"),
    )
    placed = (
        moves.select(*keys, "src", "dst").join(src_at, [*keys, "src"])
        .join(src_parent, [*keys, "src_parent"]).where("src_n > 1")
        .join(dst_at, [*keys, "dst"])
    )
    src_bits = bits.withColumnsRenamed({"node_id": "src", "bits": "src_bits"})
    dst_bits = bits.withColumnsRenamed({"node_id": "dst", "bits": "dst_bits"})
    joined = placed.join(src_bits, [*keys, "src"]).join(dst_bits, [*keys, "dst", "word"])
    inter = F.col("src_bits").bitwiseAND(F.col("dst_bits"))
    union = F.col("src_bits").bitwiseOR(F.col("dst_bits"))
    joined = joined.withColumn("graft", sw.fitch_set(inter, union)).withColumn(
        "graft_cost", sw.empty_sites(inter, union).cast("bigint")
    )
    joined = cut(joined, "grafts")
    move = [*keys, "src", "dst"]
    leave = joined.select(
        *move, "word", F.col("src_parent").alias("node_id"), F.col("src_depth").alias("depth"),
        F.col("src_bits").alias("old"), F.lit(None).cast("bigint").alias("new"), F.lit(1).alias("gone"),
    )
    arrive = joined.where(F.col("graft") != F.col("dst_bits")).select(
        *move, "word", F.col("dst_parent").alias("node_id"), F.col("dst_depth").alias("depth"),
        F.col("dst_bits").alias("old"), F.col("graft").alias("new"), F.lit(0).alias("gone"),
    )
    deltas = _climb(index, move, leave.unionByName(arrive))
    deltas.append(joined.groupBy(*move).agg(F.sum("graft_cost").alias("delta")))
    return moves.join(_total(deltas, move), move)


def _total(deltas: list[DataFrame], by: list[str]) -> DataFrame:
    total = deltas[0]
    for part in deltas[1:]:
        total = total.unionByName(part)
    return total.groupBy(*by).agg(F.sum("delta").alias("score"))


def _climb(
    index: TreeIndex, move: list[str], events: DataFrame, trace: list[DataFrame] | None = None
) -> list[DataFrame]:
    """Cost changes (move, delta) per depth as changed children climb to the root.

    Sets that changed, (move, node_id, word, set_now), are added to ``trace``.
    """
    keys = index.keys
    start = cut(events, "events", ("depth",))
    place = index.tree.nodes.select(*keys, "node_id", "parent_id")
    deltas, carried = [], None
    for d in range(index.tree.max_depth - 1, -1, -1):
        events = start.where(F.col("depth") == d).drop("depth")
        if carried is not None:
            events = events.unionByName(carried)
        met = events.groupBy(*move, "word", "node_id").agg(
            F.bit_and("old").alias("old_and"), F.bit_or("old").alias("old_or"),
            F.bit_and("new").alias("new_and"), F.bit_or("new").alias("new_or"),
            F.count(F.lit(1)).alias("k"), F.sum("gone").alias("gone"),
        )
        here = [*keys, "node_id", "word"]
        rows = _changed(met.join(index.kids, here)).join(index.sets, here)
        if d == 0:
            was = sw.empty_sites(F.col("bits").bitwiseAND(F.col("ref")), F.col("ref"))
            now = sw.empty_sites(F.col("set_now").bitwiseAND(F.col("ref")), F.col("ref"))
            rows = rows.withColumn("delta", (F.col("delta") + now - was).cast("bigint"))
            deltas.append(rows.groupBy(*move).agg(F.sum("delta").alias("delta")))
            break
        rows = cut(
            rows.join(place, [*keys, "node_id"]).select(
                *move, "word", "node_id", "parent_id", "bits", "set_now", "delta"
            ),
            "climb",
        )
        if trace is not None:
            trace.append(rows.where(F.col("set_now") != F.col("bits")).select(*move, "node_id", "word", "set_now"))
        deltas.append(rows.groupBy(*move).agg(F.sum("delta").alias("delta")))
        carried = rows.where(F.col("set_now") != F.col("bits")).select(
            *move, "word", F.col("parent_id").alias("node_id"), F.col("bits").alias("old"),
            F.col("set_now").alias("new"), F.lit(0).alias("gone"),
        )
    return deltas


@dataclass(frozen=True)
class Removal:
    """gain: (keys, src, score), the cost change of cutting each source off and leaving it out;
    shifted: (keys, src, node_id, word, set_now), sets below the root that change by it."""

    gain: DataFrame
    shifted: DataFrame


def remove_sources(index: TreeIndex, sources: DataFrame) -> Removal:
    keys = index.keys
    node = index.tree.nodes
    at = node.select(*keys, "node_id", F.col("parent_id").alias("p"))
    parent = node.select(*keys, F.col("node_id").alias("p"), "depth", "n_children").where("n_children > 1")
    leave = (
        sources.select(*keys, "node_id").join(at, [*keys, "node_id"]).join(parent, [*keys, "p"])
        .join(index.sets.select(*keys, "node_id", "word", "bits"), [*keys, "node_id"])
        .select(
            *keys, F.col("node_id").alias("src"), "word", F.col("p").alias("node_id"), "depth",
            F.col("bits").alias("old"), F.lit(None).cast("bigint").alias("new"), F.lit(1).alias("gone"),
        )
    )
    move, trace = [*keys, "src"], []
    gain = cut(_total(_climb(index, move, leave, trace), move), "gain")
    none = gain.where(F.lit(False)).select(
        *move, F.col("src").alias("node_id"), F.lit(0).alias("word"), F.lit(0).cast("bigint").alias("set_now")
    )
    return Removal(gain, reduce(DataFrame.unionByName, trace, none))


def _free(bits: Column, met: Column) -> Column:
    """``bits`` without the sites at which some base of it is in ``met``."""
    zero = F.lit(0).cast("bigint")
    return sw.fitch_set(bits.bitwiseAND(met), bits).bitwiseXOR(sw.fitch_set(bits.bitwiseAND(met), zero))


def _missed(free: Column, met: Column) -> Column:
    return F.coalesce(F.sum(sw.empty_sites(free.bitwiseAND(met), free)), F.lit(0))


def _jumps(index: TreeIndex) -> list[DataFrame]:
    """(keys, node_id, top) per power of two below the depth: the ancestor so many levels up."""
    keys, node = index.keys, index.tree.nodes
    jump = node.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", F.col("parent_id").alias("top"))
    out, width = [], 1
    while width <= index.tree.max_depth:
        out.append(jump)
        further = jump.select(*keys, F.col("node_id").alias("top"), F.col("top").alias("next"))
        jump = jump.join(further, [*keys, "top"]).select(*keys, "node_id", F.col("next").alias("top"))
        width *= 2
        if 2 <= width <= index.tree.max_depth:
            jump = cut(jump, "jump")
    return out


def _gather(rows: DataFrame, jumps: list[DataFrame], keys: list[str], value: str, upward: bool) -> DataFrame:
    """``value`` of a node and all below it (upward) or all above it, by bit_or over doubling distances."""
    at, other = ("node_id", "top") if upward else ("top", "node_id")
    for jump in jumps:
        far = rows.withColumnRenamed("node_id", at).join(jump, [*keys, at]).select(
            *keys, F.col(other).alias("node_id"), "word", value
        )
        both = rows.unionByName(far).groupBy(*keys, "node_id", "word")
        rows = cut(both.agg(F.bit_or(value).alias(value)), value)
    return rows


def leaf_bases(index: TreeIndex, jumps: list[DataFrame]) -> DataFrame:
    """(keys, node_id, word, leaves): bases of the leaves at or below a node, the reference base left out."""
    keys = index.keys
    tips = index.tree.nodes.where("n_children = 0").select(*keys, "node_id")
    other = F.col("bits").bitwiseAND(_not(F.col("ref"))).alias("leaves")
    own = index.sets.join(tips, [*keys, "node_id"]).select(*keys, "node_id", "word", other).where("leaves != 0")
    return _gather(own, jumps, keys, "leaves", True)


def shared_bases(index: TreeIndex, jumps: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(keys, node_id, word, beside) and (keys, node_id, word, above), the reference base left out.

    ``beside``: bases that all siblings of a node have; ``above``: those beside
    the node or one of its ancestors.
    """
    keys = index.keys
    up = index.tree.nodes.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", "parent_id")
    kids = index.kids.where("n > 1").select(*keys, F.col("node_id").alias("parent_id"), "word", "all_", "miss1")
    rest = F.col("all_").bitwiseOR(F.col("miss1").bitwiseAND(_not(F.col("bits"))))
    beside = up.join(index.sets, [*keys, "node_id"]).join(kids, [*keys, "parent_id", "word"]).select(
        *keys, "node_id", "word", rest.bitwiseAND(_not(F.col("ref"))).alias("beside")
    )
    beside = cut(beside.where("beside != 0"), "beside")
    return beside, _gather(beside.withColumnRenamed("beside", "above"), jumps, keys, "above", False)


class Outward:
    """Regrafts that can score at most ``threshold``, listed outwards from every source.

    Round t holds the targets t steps away: children beside the t-th ancestor's
    branch that leads to the source, and children of the targets of round t - 1.
    Rounds are kept, so a larger radius goes on where a smaller one ended, and
    all radii share the replay of the removals.

    A source with bases S at a site meets a target T there if S and T share a
    base, or if S has the reference base, or a base that all siblings of the
    target or of one of its ancestors have once the source is gone.  Where it
    meets none of them the graft costs one: the set above the target grows by
    bases of S only, no ancestor has a use for them, and no other site can make
    up for it, since putting a subtree back never lowers a site's cost.  So
    removal gain + missed sites bounds the score from below.  For all targets
    inside a subtree, T and the siblings in there are within the bases of its
    leaves; a subtree whose bound exceeds the threshold is not entered.

    Rows carry the sites (by word) that are still to be met: those where the
    source differs from the reference, so few.
    """

    def __init__(self, index: TreeIndex, threshold: int = -1, sources: DataFrame | None = None):
        self.index, self.threshold = index, threshold
        keys, node = index.keys, index.tree.nodes
        self.link = node.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", "parent_id")
        removal = remove_sources(index, searchable(index) if sources is None else sources)
        self.shifted = removal.shifted.withColumnRenamed("node_id", "via")
        slack = (F.lit(threshold) - F.col("score")).alias("slack")
        able = cut(removal.gain.where(F.col("score") <= threshold).select(*keys, "src", slack), "able")
        jumps = _jumps(index)
        leaves = leaf_bases(index, jumps)
        kept = child_profiles(index.tree, leaves.withColumnRenamed("leaves", "bits")).select(
            *keys, F.col("node_id").alias("lca"), "word", F.col("any_").alias("any_leaf"), F.col("one").alias("one_leaf")
        )
        self.families = cut(kept, "families")
        beside, above = shared_bases(index, jumps)
        self.above = above.withColumnRenamed("node_id", "lca")
        self.places = cut(
            index.sets.join(leaves, [*keys, "node_id", "word"], "left").join(beside, [*keys, "node_id", "word"], "left")
            .na.fill(0, ["leaves", "beside"]), "places"
        )
        free = _free(F.col("bits"), F.col("ref")).alias("free")
        need = index.sets.withColumnRenamed("node_id", "src").select(*keys, "src", "word", free).where("free != 0")
        self.need = cut(need.join(able, [*keys, "src"], "left_semi"), "need")
        self.tops = able.select("*", F.col("src").alias("lca"))
        self.rounds: list[DataFrame] = []

    def _beside_top(self) -> DataFrame:
        """Targets below the next ancestor, beside the branch to the source."""
        keys, index, first = self.index.keys, self.index, not self.rounds
        up = self.link.select(*keys, F.col("node_id").alias("via"), F.col("parent_id").alias("lca"))
        tops = self.tops.select(*keys, "src", "slack", F.col("lca").alias("via")).join(up, [*keys, "via"])
        self.tops = cut(tops, "tops")
        via = self.places.select(
            *keys, F.col("node_id").alias("via"), "word", F.col("bits").alias("via_bits"),
            F.col("leaves").alias("via_leaves"), "ref",
        )
        zero = F.lit(0).cast("bigint")
        rows = (
            self.tops.join(self.need, [*keys, "src"], "left").join(self.above, [*keys, "lca", "word"], "left")
            .join(via, [*keys, "via", "word"], "left").join(self.shifted, [*keys, "src", "via", "word"], "left")
            .join(self.families, [*keys, "lca", "word"], "left")
        )
        # What the branch that held the source offers now; in the first round it is gone.
        now = zero if first else F.coalesce("set_now", "via_bits")
        others = F.coalesce(F.col("any_leaf").bitwiseAND(_not(F.col("one_leaf").bitwiseAND(F.col("via_leaves")))), zero)
        rows = rows.select(
            *keys, "src", "slack", "lca", "via", "word", "via_bits", now.alias("now"), others.bitwiseOR(now).alias("met"),
            _free(F.col("free"), F.coalesce("above", zero)).alias("free"),
        )
        some = F.when(F.col("free") != 0, F.struct("word", "free", "via_bits", "now"))
        rows = rows.groupBy(*keys, "src", "slack", "lca", "via").agg(
            _missed(F.col("free"), F.col("met")).alias("missed"), F.collect_list(some).alias("words")
        ).where("missed <= slack")
        kids = index.kids.select(*keys, F.col("node_id").alias("lca"), "word", "all_", "miss1", "miss2", "n")
        rows = (
            rows.join(self.link.withColumnRenamed("parent_id", "lca"), [*keys, "lca"]).where("node_id != via")
            .select(*keys, "src", "slack", "lca", "node_id", F.inline_outer("words"))
            .join(kids, [*keys, "lca", "word"], "left").join(self.places, [*keys, "node_id", "word"], "left")
        )
        both = F.col("via_bits").bitwiseAND(F.col("bits"))
        either = F.col("via_bits").bitwiseOR(F.col("bits"))
        rest = (
            F.col("all_").bitwiseOR(F.col("miss1").bitwiseAND(_not(both))).bitwiseOR(F.col("miss2").bitwiseAND(_not(either)))
        )
        common = F.when(F.col("n") > 2, rest).otherwise(zero) if first else rest.bitwiseAND(F.col("now"))
        return rows.withColumn("met", common)

    def _next(self) -> DataFrame:
        keys = self.index.keys
        pick = [*keys, "src", "slack", "lca", "node_id", "word", "free", "met", "bits", "leaves"]
        # No source has more ancestors than the tree is deep.
        parts = [self._beside_top().select(*pick)] if len(self.rounds) < max(self.index.tree.max_depth, 1) else []
        if self.rounds:
            last = self.rounds[-1].withColumnRenamed("node_id", "parent_id")
            deeper = (
                last.join(self.link, [*keys, "parent_id"])
                .select(*keys, "src", "slack", "lca", "node_id", F.inline_outer("words"))
                .join(self.places, [*keys, "node_id", "word"], "left").withColumnRenamed("beside", "met")
            )
            parts.append(deeper.select(*pick))
        rows = reduce(DataFrame.unionByName, parts).withColumn("free", _free(F.col("free"), F.col("met")))
        some = F.when(F.col("free") != 0, F.struct("word", "free"))
        return cut(
            rows.groupBy(*keys, "src", "slack", "lca", "node_id").agg(
                _missed(F.col("free"), F.col("bits")).alias("missed"),
                _missed(F.col("free"), F.col("leaves")).alias("missed_below"),
                F.collect_list(some).alias("words"),
            ).where("missed_below <= slack"), "outward",
        )

    def moves(self, radius: int) -> DataFrame:
        """(keys, src, dst, lca) of the regrafts within ``radius`` that the bound lets pass.

        Regrafts onto a sibling, which only narrow the set of their parent and so
        never lower the cost, are left out for a threshold below zero.
        """
        # No two nodes are further apart than twice the depth.
        radius = min(radius, max(2 * self.index.tree.max_depth - 1, 1))
        while len(self.rounds) < radius:
            self.rounds.append(self._next())
        rounds = self.rounds[:radius]
        if self.threshold < 0 and len(rounds) > 1:
            rounds = rounds[1:]
        elif self.threshold < 0:
            rounds = [rounds[0].where(F.lit(False))]
        found = reduce(DataFrame.unionByName, rounds)
        return found.where("missed <= slack").select(*self.index.keys, "src", F.col("node_id").alias("dst"), "lca")


#: Words up to which a node's sets stand in one row, and radius up to which the walk over bifurcating
#: trees, which leaves out sources but no targets, is preferred to listing targets under a bound.
WALK_WORDS, WALK_RADIUS = 8, 8


def _walk_words(index: TreeIndex) -> int:
    """Number of words if ``walk_moves`` applies to the trees, else 0."""
    if index.tree.nodes.where("n_children > 2").isEmpty():
        last = index.sets.agg(F.max("word")).first()[0]
        return last + 1 if last is not None and last < WALK_WORDS else 0
    return 0


def _fitch(a: Column, b: Column) -> Column:
    return sw.fitch_set(a.bitwiseAND(b), a.bitwiseOR(b))


def walk_moves(index: TreeIndex, radius: int, threshold: int, words: int) -> DataFrame:
    """Moves of bifurcating trees within ``radius`` that score at most ``threshold``, by a walk outwards.

    The cost of such a tree is the same from wherever it is rooted, the
    reference being a leaf above the root.  So a subtree with bases S on an edge
    costs one per site at which S has no base of the edge's set, the Fitch set
    of what its two ends offer.  An end that leads away from the source offers
    what it does in the whole tree; the other follows step by step from the
    source's place.  Where the source stands itself it costs what its removal
    gains, so a score is the difference of two such costs and nothing has to
    be replayed up to the root.

    Sets stand in columns, one for each of the ``words``.
    """
    keys, w = index.keys, range(words)
    zero = F.lit(0).cast("bigint")
    node = index.tree.nodes.select(*keys, "node_id", "parent_id", "depth", "n_children")

    def cols(name: str) -> list[str]:
        return [f"{name}{i}" for i in w]

    def named(name: str, values) -> list[Column]:
        return [v.alias(c) for c, v in zip(cols(name), values)]

    def fitch_of(a: str, b: str) -> list[Column]:
        """Fitch sets of two ends; one that is not there (null) leaves the other's."""
        return [F.when(F.col(y).isNull(), F.col(x)).when(F.col(x).isNull(), F.col(y)).otherwise(_fitch(F.col(x), F.col(y))) for x, y in zip(cols(a), cols(b))]

    def cost(source: str, edge: list[Column]) -> Column:
        """Sites at which the source has no base of the edge's set."""
        return reduce(lambda a, b: a + b, [sw.empty_sites(F.col(s).bitwiseAND(e), e) for s, e in zip(cols(source), edge)]).cast("int")

    def per_word(value: str, name: str) -> list[Column]:
        return [F.coalesce(F.max(F.when(F.col("word") == i, F.col(value))), zero).alias(c) for i, c in zip(w, cols(name))]

    own = cut(index.sets.groupBy(*keys, "node_id").agg(*per_word("bits", "d"), *per_word("ref", "r")), "own")
    body = node.join(own.select(*keys, "node_id", *cols("d")), [*keys, "node_id"])
    # node_id with its sets, its parent and its sibling's sets (null without one)
    pair = body.where(F.col("parent_id").isNotNull()).groupBy(*keys, "parent_id").agg(
        F.collect_list(F.struct("node_id", "depth", "n_children", *cols("d"))).alias("pair")
    )
    one = pair.select(*keys, "parent_id", F.posexplode("pair").alias("at", "me"), "pair").select(
        *keys, "parent_id", "me.*", F.try_element_at("pair", F.lit(2) - F.col("at")).alias("beside")
    )
    kin = cut(one.select(
        *keys, "parent_id", "node_id", "depth", "n_children", *cols("d"), F.col("beside.node_id").alias("sibling"),
        *[F.col(f"beside.d{i}").alias(f"b{i}") for i in w],
    ), "kin", ("depth",))
    # u: what the parent offers a node, the whole tree without the node's own part
    top = node.where(F.col("parent_id").isNull()).join(own, [*keys, "node_id"])
    up = cut(top.select(*keys, "node_id", *named("u", [F.col(c) for c in cols("r")])), "offers")
    offers = [up]
    for d in range(1, index.tree.max_depth + 1):
        here = kin.where(F.col("depth") == d).join(up.withColumnRenamed("node_id", "parent_id"), [*keys, "parent_id"])
        up = cut(here.select(*keys, "node_id", *named("u", fitch_of("u", "b"))), "offers")
        offers.append(up)
    every = reduce(DataFrame.unionByName, offers)

    # The sources whose removal gains enough; n: what the branch without the source offers the next node up.
    stand = kin.where("sibling is not null").join(searchable(index).select(*keys, "node_id"), [*keys, "node_id"], "left_semi")
    stand = stand.join(every.withColumnRenamed("node_id", "parent_id"), [*keys, "parent_id"])
    lone = stand.select(
        *keys, F.col("node_id").alias("src"), F.col("parent_id").alias("at"), F.col("sibling").alias("node_id"),
        *named("s", [F.col(c) for c in cols("d")]), *named("n", [F.col(c) for c in cols("b")]),
        *named("m", [F.col(c) for c in cols("u")]), F.lit(None).cast("int").alias("gain"),
    )
    lone = lone.withColumn("gain", cost("s", [_fitch(F.col(x), F.col(y)) for x, y in zip(cols("m"), cols("n"))])).where(F.col("gain") >= -threshold)
    lone = cut(lone, "sources")
    state = [*keys, "src", "gain", *cols("s")]
    climb = lone.select(*state, "at", *cols("n"))
    front = lone.select(*state, F.col("at").alias("lca"), "node_id", *cols("m"))
    below = kin.select(*keys, F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), *cols("d"), *cols("b"))
    found = [lone.select(*keys, "src", F.col("node_id").alias("dst"), F.col("at").alias("lca"), F.lit(0).cast("bigint").alias("score")).where(F.lit(threshold >= 0))]
    # No two nodes are further apart than twice the depth.
    for t in range(2, min(radius, max(2 * index.tree.max_depth - 1, 1)) + 1):
        last = t == radius
        parts = [
            front.join(below, [*keys, "node_id"]).select(
                *state, "lca", F.col("child").alias("node_id"), *cols("d"), *named("m", fitch_of("m", "b"))
            )
        ]
        if t <= index.tree.max_depth:
            # one level up: beside the branch, and the next place to climb from
            over = climb.join(
                kin.select(*keys, F.col("node_id").alias("at"), F.col("parent_id").alias("above"), "sibling", *cols("b")), [*keys, "at"]
            ).join(every.withColumnRenamed("node_id", "above"), [*keys, "above"])
            over = cut(over, "over")
            parts.append(
                over.where("sibling is not null").select(
                    *state, F.col("above").alias("lca"), F.col("sibling").alias("node_id"), *named("d", [F.col(c) for c in cols("b")]), *named("m", fitch_of("n", "u"))
                )
            )
            climb = over.select(*state, F.col("above").alias("at"), *named("n", fitch_of("n", "b")))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.withColumn("score", (cost("s", [_fitch(F.col(x), F.col(y)) for x, y in zip(cols("m"), cols("d"))]) - F.col("gain")).cast("bigint"))
        if last:
            # Exploded, so that the condition below is not moved into the steps before: its code would grow too long.
            rows = rows.select(*keys, "src", "lca", "node_id", F.explode_outer(F.array("score")).alias("score"))
        else:
            rows = cut(rows.select(*state, "lca", "node_id", *cols("m"), "score"), "walk")
            front = rows.select(*state, "lca", "node_id", *cols("m"))
        found.append(rows.where(F.col("score") <= threshold).select(*keys, "src", F.col("node_id").alias("dst"), "lca", "score"))
    return reduce(DataFrame.unionByName, found)


def find_moves(index: TreeIndex, radius: int, threshold: int = -1, outward: Outward | None = None) -> DataFrame:
    """All moves within ``radius`` whose score is at most ``threshold``.

    ``outward`` is the listing of a smaller radius of the same index and threshold, to go on with.
    Bifurcating trees of few sites are walked instead, unless a listing is at hand.
    """
    words = _walk_words(index) if outward is None and radius <= WALK_RADIUS else 0
    if words:
        return walk_moves(index, radius, threshold, words)
    outward = outward or Outward(index, threshold)
    return score_moves(index, outward.moves(radius)).where(F.col("score") <= threshold)


def affected_nodes(tree: fitch.Tree, moves: DataFrame, radius: int) -> DataFrame:
    """(keys, src, dst, node_id): nodes from the parents of both ends up to the LCA."""
    keys = list(tree.keys)
    paths = paths_up(tree, radius).select(*keys, "node_id", "anc", "up")
    out = None
    for end in ("src", "dst"):
        way = paths.withColumnsRenamed({"node_id": end, "anc": "on", "up": "at"})
        stop = paths.select(*keys, F.col("node_id").alias(end), F.col("anc").alias("lca"), F.col("up").alias("top"))
        one = moves.join(stop, [*keys, end, "lca"]).join(way, [*keys, end]).where("at <= top").select(
            *keys, "src", "dst", F.col("on").alias("node_id")
        )
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def apply_moves(dag: HistoryDag, moves: DataFrame, refit: bool = True) -> HistoryDag:
    """One moved copy of its tree per move.

    ``moves``: dag_id, move_id, src, dst.  The copy's ``dag_id`` is
    ``<dag>#<move_id>``.  A parent left with one child is dissolved.  Inner
    genomes are refitted unless ``refit`` is off.
    """
    e = dag.edges.select("dag_id", "edge_id", "parent_id", "child_id", "clade_index", "edge_weight")
    size = e.groupBy("dag_id", F.col("parent_id").alias("sp")).agg(F.count(F.lit(1)).alias("n"))
    fresh = dag.nodes.groupBy("dag_id").agg(_fresh_id(dag).alias("fresh"))
    name = F.concat_ws("#", "dag_id", F.col("move_id").cast("string"))
    src_edge = e.select("dag_id", F.col("child_id").alias("src"), F.col("parent_id").alias("sp"))
    dst_edge = e.select(
        "dag_id", F.col("child_id").alias("dst"), F.col("parent_id").alias("dp"), F.col("clade_index").alias("dst_clade")
    )
    above = e.select(
        "dag_id", F.col("child_id").alias("sp"), F.col("parent_id").alias("gp"), F.col("clade_index").alias("gp_clade")
    )
    plan = (
        moves.select("dag_id", "move_id", "src", "dst", name.alias("tree"))
        .join(src_edge, ["dag_id", "src"]).join(dst_edge, ["dag_id", "dst"])
        .join(size, ["dag_id", "sp"]).join(above, ["dag_id", "sp"]).join(fresh, "dag_id")
        .where((F.col("n") > 1) & ~((F.col("n") == 2) & (F.col("sp") == F.col("dp"))))
        .withColumn("dissolve", F.col("n") == 2)
    )
    plan = cut(plan, "plan")
    all_edges = plan.join(e, "dag_id")
    dropped = (
        (F.col("child_id") == F.col("src")) | (F.col("child_id") == F.col("dst"))
        | (F.col("dissolve") & ((F.col("child_id") == F.col("sp")) | (F.col("parent_id") == F.col("sp"))))
    )
    kept = all_edges.where(~dropped).select("tree", "parent_id", "child_id", "clade_index", "edge_weight")
    sibling = all_edges.where(
        F.col("dissolve") & (F.col("parent_id") == F.col("sp")) & (F.col("child_id") != F.col("src"))
    )
    # When the sibling itself heads the path to dst's edge, its new parent is the grandparent.
    lifted = sibling.where(F.col("child_id") != F.col("dst")).select(
        "tree", F.col("gp").alias("parent_id"), "child_id", F.col("gp_clade").alias("clade_index"), "edge_weight"
    )
    new_parent = F.when(F.col("dissolve") & (F.col("dp") == F.col("sp")), F.col("gp")).otherwise(F.col("dp"))
    zero = F.lit(0.0).alias("edge_weight")
    graft = plan.select(
        "tree", new_parent.alias("parent_id"), F.col("fresh").alias("child_id"),
        F.col("dst_clade").alias("clade_index"), zero,
    )
    ends = plan.select("tree", "fresh", F.inline(F.array(
        F.struct(F.col("dst").alias("child_id"), F.lit(0).alias("clade_index")),
        F.struct(F.col("src").alias("child_id"), F.lit(1).alias("clade_index")),
    ))).select("tree", F.col("fresh").alias("parent_id"), "child_id", "clade_index", zero)
    arcs = kept.unionByName(lifted).unionByName(graft).unionByName(ends)
    edges = arcs.select(
        F.col("tree").alias("dag_id"), F.xxhash64("parent_id", "child_id").alias("edge_id"),
        "parent_id", "child_id", "clade_index",
        F.array().cast(dag.edges.schema["mutations"].dataType).alias("mutations"), "edge_weight",
    )
    old = plan.join(dag.nodes, "dag_id").where(~(F.col("dissolve") & (F.col("node_id") == F.col("sp")))).select(
        F.col("tree").alias("dag_id"), "node_id", "kind", "sample_id", "cg"
    )
    new = plan.select(
        F.col("tree").alias("dag_id"), F.col("fresh").alias("node_id"), F.lit("inner").alias("kind"),
        F.lit(None).cast("string").alias("sample_id"), F.array().cast(GENOME).alias("cg"),
    )
    refs = plan.select("dag_id", "tree").join(dag.refs, "dag_id").select(
        F.col("tree").alias("dag_id"), "reference_id", "reference_seq"
    )
    moved = HistoryDag(cut(old.unionByName(new), "moved"), cut(edges, "moved"), refs)
    return fitch.fitch_assign(moved) if refit else moved


def _fresh_id(dag: HistoryDag) -> Column:
    """An id no node of the tree has."""
    if dag.nodes.schema["node_id"].dataType.typeName() == "string":
        return F.concat(F.lit("~"), F.max("node_id"))
    return F.least(F.min("node_id"), F.lit(0)) - 1
