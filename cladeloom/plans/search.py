"""Optimising a DAG: sample trees, find moves, merge the moved trees, repeat.

The driver holds a handful of scores; trees, moves and DAGs stay distributed,
and all DAGs of a container advance together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT, uniform_draw
from cladeloom.operators import diverse, dp, fitch, intervals, leafsets, likelihood, merge, rf, sampling, spr, trim
from cladeloom.operators import semiring as sr
from cladeloom.operators.levels import EdgeLevels, depths, rank_edges
from cladeloom.plans.options import SearchOptions, WalkOptions
from cladeloom.runtime import cut, materialise
from cladeloom.schema import HistoryDag

ARC = ["dag_id", "parent_id", "clade_index", "child_id"]


def own_dag() -> Column:
    """The DAG a tree was drawn from: what precedes the number sign of its id (``plain_ids``)."""
    return F.substring_index("dag_id", "#", 1)


def plain_ids(dag: HistoryDag) -> HistoryDag:
    """Ids without the sign that sets off draws and moves; loaders name DAGs by paths, which may hold it."""
    name = F.replace("dag_id", F.lit("#"), F.lit("%23"))
    return HistoryDag(*(t.withColumn("dag_id", name) for t in (dag.nodes, dag.edges, dag.refs)))


def _flag_root_edges(dag: HistoryDag) -> DataFrame:
    uas = dag.nodes.where("kind = 'ua'").select(
        "dag_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("parent_is_ua")
    )
    return dag.edges.join(uas, ["dag_id", "parent_id"], "left").na.fill(False, ["parent_is_ua"])


def rf_levels(dag: HistoryDag, reference: HistoryDag | None = None) -> tuple[EdgeLevels, DataFrame]:
    """Levels whose edges carry ``rf_w`` against ``reference`` (default: the DAG
    itself), and the (dag_id, shift) to add to a sum."""
    reference = reference or dag
    levels = leafsets.levels_with_leaves(dag)
    keys = leafsets.leaf_keys(levels)
    ref_levels = levels if reference is dag else leafsets.levels_with_leaves(reference)
    ref_keys = keys if reference is dag else leafsets.leaf_keys(ref_levels)
    counts = dp.below(ref_levels, sr.TreeCount())
    uas = reference.nodes.where("kind = 'ua'").select("dag_id", "node_id")
    every = ref_keys.edges.select("dag_id", F.col("child_id").alias("node_id"), "key").distinct().join(
        uas, ["dag_id", "node_id"], "left_anti"
    )
    multiplicity = cut(rf.clade_multiplicity(every, dp.above_counts(counts), counts.nodes, ["dag_id"]), "clades")
    totals = counts.top.select("dag_id", F.col("n").alias("num_trees"))
    if reference is not dag:
        # One reference DAG serves every DAG of the container.
        ids = dag.refs.select("dag_id")
        multiplicity = ids.crossJoin(multiplicity.drop("dag_id"))
        totals = ids.crossJoin(totals.drop("dag_id"))
    weighted = rf.rf_weights(keys.edges.drop("leaf_name", "w", "edge_w"), multiplicity, totals, ["dag_id"])
    ranked = cut(weighted.select(*ARC, "edge_id", "parent_rank", "child_rank", "rf_w"), "rf", ("child_rank",))
    return replace(levels, ranked=ranked), rf.rf_shift(multiplicity, ["dag_id"])


def weigh(dag: HistoryDag, method: str, model=None, reference: HistoryDag | None = None) -> tuple[EdgeLevels, sr.BestWeight]:
    """Levels and weight of a sampling or trimming criterion."""
    if method == "parsimony":
        return rank_edges(dag), sr.BestWeight()
    if method == "parsimony-max":
        return rank_edges(dag), sr.BestWeight(largest=True)
    if method == "parsimony-ua-free":
        return rank_edges(dag, _flag_root_edges(dag)), sr.BestWeight(sr.mutation_cost_off_root())
    if method == "edge-weight":
        return rank_edges(dag), sr.BestWeight(sr.stored_weight(), dtype="double", tolerant=True)
    if method == "ml":
        nll = likelihood.edge_nll(dag, model.loglik)
        scored = dag.edges.join(nll, ["dag_id", "edge_id", "parent_id", "child_id"])
        return rank_edges(dag, scored), sr.BestWeight(F.col("nll"), dtype="double", tolerant=True)
    if method in ("rf-min", "rf-max"):
        levels, _ = rf_levels(dag, reference)
        return levels, rf.best_sum_rf(method == "rf-max")
    raise ValueError(f"unknown criterion {method!r}")


def best_score(dag: HistoryDag, method: str = "parsimony", model=None) -> DataFrame:
    """(dag_id, w): optimum of a criterion per DAG."""
    levels, ops = weigh(dag, method, model)
    return dp.below(levels, ops).top.select("dag_id", "w")


def _tree_log_counts(levels: EdgeLevels, edges: DataFrame) -> DataFrame:
    """(dag_id, node_id, log_n): logarithm of the trees below every inner node using only ``edges``."""
    ranked = cut(levels.ranked.join(edges.select(*ARC), ARC, "left_semi"), "kept", ("child_rank",))
    return dp.below(replace(levels, ranked=ranked), sr.TreeLogCount()).nodes.select("dag_id", "node_id", "log_n")


def sample_trees(
    dag: HistoryDag, draws: int, seed: int, method: str = "parsimony", uniform: bool = False,
    model=None, reference: HistoryDag | None = None, refit: bool = True,
) -> HistoryDag:
    """``draws`` trees per DAG, optimal under ``method`` (any tree for ``random``).

    Alternatives are equally likely, or, with ``uniform``, all trees are.
    """
    sampling.SamplePlan(method, uniform)
    if method == "random":
        levels, allowed = rank_edges(dag), dag.edges
    else:
        levels, ops = weigh(dag, method, model, reference)
        best = dp.below(levels, ops).best_edges().select(*ARC).distinct()
        allowed = cut(dag.edges.join(best, ARC, "left_semi"), "best")
    if uniform:
        counts = _tree_log_counts(levels, allowed).withColumnsRenamed({"node_id": "child_id", "log_n": "pick_log"})
        allowed = cut(
            # only leaves have no count: below them there is one tree
            allowed.join(counts, ["dag_id", "child_id"], "left").withColumn("pick_log", F.coalesce("pick_log", F.lit(0.0))),
            "weighted",
        )

        def key(d):
            return sampling.log_weighted_key(seed, d, F.col("pick_log"), *ARC)
    else:

        def key(d):
            return sampling.edge_uniform_key(seed, d, *ARC)

    roots = dag.roots().select("dag_id", "node_id")
    numbers = dag.refs.select("dag_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picked = sampling.sample_edges(allowed, roots, numbers, key)
    trees = materialise(sampling.as_trees(dag, picked.select("draw", "dag_id", *[c for c in dag.edges.columns if c != "dag_id"])), "trees")
    return fitch.fitch_assign(trees) if refit else trees


def tree_scores(trees: HistoryDag) -> DataFrame:
    """(dag_id, mutations, edge_weight): totals over the edges of each tree."""
    return trees.edges.groupBy("dag_id").agg(
        F.sum(F.size("mutations")).cast("bigint").alias("mutations"), F.sum("edge_weight").alias("edge_weight")
    )


def diverse_trees(dag: HistoryDag, k: int, pool: int, seed: int) -> DataFrame:
    """(g, rank, tree, gap) and the pool: k optimal trees far apart from each other."""
    trees = sample_trees(dag, pool, seed)
    keys = leafsets.leaf_keys(leafsets.levels_with_leaves(trees))
    clades = cut(rf.tree_clades(trees, keys.nodes).withColumn("g", own_dag()), "clades")
    unique = diverse.distinct_topologies(
        diverse.topology_keys(clades, ["g", "dag_id"]), "g", "dag_id"
    ).select("g", "dag_id")
    scored = cut(unique.join(tree_scores(trees), "dag_id"), "scored")
    # Pool-sized groups: at most ``pool`` trees per DAG.
    from pyspark.sql import Window

    place = F.rank().over(Window.partitionBy("g").orderBy("mutations"))
    kept = scored.withColumn("place", place).where(F.col("place") <= diverse.keep_count(k)).select("g", "dag_id")
    return diverse.farthest_first(clades, k, trees=kept), trees


def random_moves(index: spr.TreeIndex, seed: int, attempts: int = 100, keep: int = 10) -> DataFrame:
    """Up to ``keep`` random valid moves per tree out of ``attempts`` drawn pairs."""
    keys = index.keys
    nodes = index.tree.nodes.where(F.col("parent_id").isNotNull()).select(*keys, "node_id")

    def draw(tag: str, name: str) -> DataFrame:
        h = F.xxhash64(F.lit(seed), F.lit(tag), "node_id")
        slot = F.pmod(h, F.lit(attempts)).alias("slot")
        return nodes.groupBy(*keys, slot).agg(F.min_by("node_id", h).alias(name))

    pairs = draw("s", "src").join(draw("d", "dst"), [*keys, "slot"]).where(F.col("src") != F.col("dst"))
    spans = cut(intervals.euler_intervals(index.tree.nodes, list(keys)), "intervals")
    placed = intervals.with_intervals(pairs, spans, list(keys), "src", "dst")
    valid = placed.where(~intervals.is_above("src", "dst") & ~intervals.is_above("dst", "src"))
    ranked = valid.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("slot", "src", "dst"))), 1, keep).alias("m"))
    return ranked.select(*keys, F.inline("m")).drop("slot")


def _named(moves: DataFrame) -> DataFrame:
    return moves.withColumn(
        "move_id", F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
    )


def _best_moves(moves: DataFrame, k: int) -> DataFrame:
    """The k best moves of every tree: a bounded min-heap per tree, merged map-side.  All moves for k = 0."""
    from pyspark.sql import Window

    if not k:
        return moves
    moves = moves.withColumn("slice", F.pmod(F.xxhash64("src", "dst"), F.lit(64)))
    order = ["score", "src", "dst"]
    inner = Window.partitionBy("dag_id", "slice").orderBy(*order)
    outer = Window.partitionBy("dag_id").orderBy(*order)
    first = moves.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k)
    return first.withColumn("r", F.row_number().over(outer)).where(F.col("r") <= k).drop("r", "slice")


def rescore(
    fragments: HistoryDag, moves: DataFrame, options: SearchOptions, known: HistoryDag, base: HistoryDag
) -> DataFrame:
    """(dag_id, final) of fragments that strictly improve after rescoring."""
    named = moves.select(F.concat_ws("#", "dag_id", "move_id").alias("dag_id"), F.col("dag_id").alias("tree"), "score")
    if options.likelihood_coeff:
        new = likelihood.dag_nll(likelihood.edge_nll(fragments, options.model.loglik))
        old = likelihood.dag_nll(likelihood.edge_nll(base, options.model.loglik)).withColumnsRenamed(
            {"dag_id": "tree", "nll": "old"}
        )
        gain = F.col("old") - F.col("nll")
        final = named.join(new, "dag_id").join(old, "tree").select(
            "dag_id", (options.score_coeff * F.col("score") - options.likelihood_coeff * gain).alias("final")
        )
        return final.where(F.col("final") < -1e-10)
    if options.node_coeff:
        novel = merge.novel_nodes(
            fragments, leafsets.leaf_keys(leafsets.levels_with_leaves(fragments)),
            leafsets.leaf_keys(leafsets.levels_with_leaves(known)), own_dag(),
        )
        total = options.score_coeff * F.col("score") + options.node_coeff * F.col("novel")
        return named.join(novel, "dag_id").select("dag_id", total.alias("final")).where(F.col("final") < 0)
    return named.select("dag_id", F.col("score").alias("final"))


def as_strings(dag: HistoryDag) -> HistoryDag:
    """Node ids as strings, so that loaded and merged DAGs can be stacked."""
    text = {c: F.col(c).cast("string") for c in ("parent_id", "child_id")}
    edges = dag.edges.withColumns(text).select(
        "dag_id", "edge_id", "parent_id", "child_id", "clade_index", "mutations", "edge_weight"
    )
    nodes = dag.nodes.withColumn("node_id", F.col("node_id").cast("string")).select(
        "dag_id", "node_id", "kind", "sample_id", "cg"
    )
    return HistoryDag(nodes, edges, dag.refs)


def merge_all(parts: list[HistoryDag]) -> HistoryDag:
    """Merge of all parts, one DAG per original dag_id."""
    stacked = reduce(HistoryDag.union, [as_strings(p) for p in parts])
    return merge.merge(materialise(stacked, "stack"), own_dag())


def keep_dags(dag: HistoryDag, ids: DataFrame) -> HistoryDag:
    return HistoryDag(*(t.join(ids, "dag_id", "left_semi") for t in (dag.nodes, dag.edges, dag.refs)))


def subtree_of(trees: HistoryDag, least: int, most: int, seed: int) -> DataFrame:
    """(dag_id, node_id): one clade per tree with least..most leaves, heavier edges likelier."""
    levels = rank_edges(trees)
    sizes = dp.below(levels, sr.SubtreeSize()).nodes.where(F.col("leaves").between(least, most))
    entry = trees.edges.select("dag_id", F.col("child_id").alias("node_id"), F.size("mutations").alias("m"))
    pool = sizes.join(entry, ["dag_id", "node_id"])
    weight = (F.col("m") * F.col("m") + 1).cast("double")
    tick = -F.log(uniform_draw(F.lit(str(seed)), "dag_id", F.col("node_id").cast("string"))) / weight
    return pool.groupBy("dag_id").agg(F.min_by("node_id", tick).alias("node_id"))


def inside(moves: DataFrame, index: spr.TreeIndex, roots: DataFrame) -> DataFrame:
    """Moves whose both ends lie strictly below the chosen node of their tree."""
    spans = cut(intervals.euler_intervals(index.tree.nodes, ["dag_id"]), "intervals")
    within = cut(intervals.strictly_below(spans, roots, ["dag_id"]), "region")
    src = within.withColumnRenamed("node_id", "src")
    dst = within.withColumnRenamed("node_id", "dst")
    return moves.join(src, ["dag_id", "src"], "left_semi").join(dst, ["dag_id", "dst"], "left_semi")


def _best_fragments(scored: DataFrame, k: int) -> DataFrame:
    """The k fragments of least final score of every tree (all for 0); at most the moves kept before."""
    from pyspark.sql import Window

    if not k:
        return scored
    tree = F.regexp_replace("dag_id", "#[^#]*$", "")
    place = F.row_number().over(Window.partitionBy(tree).orderBy("final", "dag_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search_round(dag: HistoryDag, options: SearchOptions, seed: int) -> HistoryDag:
    """One iteration: a sampled tree per DAG, its moves at growing radii, merged in."""

    def fresh(s):
        trees = sample_trees(dag, 1, s, options.method, options.uniform, options.model)
        return trees, spr.index_dag(trees)

    trees, index = fresh(seed)
    if options.strategy == "random":
        moves = _named(cut(random_moves(index, seed, options.random_attempts, options.random_keep), "random"))
        return merge_all([dag, spr.apply_moves(trees, moves), trees])
    limit = options.max_radius or max(2 * index.tree.max_depth, 2)
    threshold = 0 if options.node_coeff else -1
    keep = options.max_moves * (3 if options.node_coeff else 1)
    region = subtree_of(trees, *options.subtree_leaves, seed) if options.subtree_leaves else None
    radius, outward = 2, None
    while radius <= limit:
        if options.producer:
            moves = options.producer(index, radius, threshold)
        else:
            outward = outward or spr.Outward(index, threshold)
            moves = spr.find_moves(index, radius, threshold, outward)
        if region is not None:
            moves = inside(moves, index, region)
        moves = cut(_named(_best_moves(moves, keep)), "moves")
        parts = [dag, trees]
        if not moves.isEmpty():
            fragments = spr.apply_moves(trees, moves)
            good = _best_fragments(rescore(fragments, moves, options, dag, trees), options.max_moves)
            parts.append(keep_dags(fragments, cut(good.select("dag_id"), "good")))
        dag = merge_all(parts)
        radius *= 2
        if options.sample_per_radius and radius <= limit:
            (trees, index), outward = fresh(seed + radius), None
    return dag


@dataclass
class Patience:
    """Stops after ``limit`` rounds without a lower objective."""

    limit: int | None
    tolerance: float = 0.0
    best: float | None = None
    idle: int = 0

    def done(self, value: float) -> bool:
        if self.limit is None:
            return False
        slack = self.tolerance * max(1.0, abs(value))
        if self.best is None or value < self.best - slack:
            self.best, self.idle = value, 0
        else:
            self.idle += 1
        return self.idle >= self.limit


def objective(dag: HistoryDag, options: SearchOptions) -> float:
    """Sum of the DAGs' optima, lower is better."""
    method = "parsimony" if options.method == "random" else options.method
    total = best_score(dag, method, options.model).agg(F.sum("w")).first()[0]
    return -float(total) if method == "rf-max" else float(total)


def walk(trees: HistoryDag, options: WalkOptions, seed: int) -> tuple[HistoryDag, list[HistoryDag]]:
    """A path of moves on every tree at once; returns end trees and emitted trees.

    Each step scores all moves within the radius and takes one per tree: the
    best, a uniform pick, or a pick with odds exp(-increase / temperature).  A
    tree stops when it has no move or would exceed its worsening budget.
    """
    current, emitted = trees, []
    budget = cut(trees.refs.select("dag_id", F.lit(0).cast("bigint").alias("spent")), "budget")
    names = trees.refs.select("dag_id")
    for step in range(options.max_steps):
        index = spr.index_dag(current)
        radius = options.radius or max(2 * index.tree.max_depth, 1)
        moves = spr.find_moves(index, radius, options.accept_threshold).join(budget, "dag_id")
        heat = options.temperature * options.cooling**step
        u = uniform_draw(F.lit(str(seed)), F.lit(str(step)), "dag_id", F.col("src").cast("string"), F.col("dst").cast("string"))
        if options.selector == "best" or (options.selector == "weighted" and heat < 1e-10):
            key = F.struct(F.col("score"), u)
        elif options.selector == "uniform":
            key = F.struct(F.lit(0), u)
        else:
            odds = F.exp(-F.greatest(F.col("score"), F.lit(0)) / F.lit(heat))
            key = F.struct(F.lit(0), -F.log(u) / F.greatest(odds, F.lit(1e-300)))
        picked = moves.groupBy("dag_id").agg(
            F.min_by(F.struct("src", "dst", "score"), key).alias("m"), F.any_value("spent").alias("spent")
        ).select("dag_id", "m.*", (F.col("spent") + F.greatest(F.col("m.score"), F.lit(0))).alias("spent"))
        if options.worsening_budget is not None:
            picked = picked.where((F.col("score") <= 0) | (F.col("spent") <= options.worsening_budget))
        picked = cut(picked, "picked")
        if picked.isEmpty():
            break
        moved = spr.apply_moves(current, picked.withColumn("move_id", F.lit("w")))
        back = F.regexp_replace("dag_id", "#w$", "")
        moved = HistoryDag(*(t.withColumn("dag_id", back) for t in (moved.nodes, moved.edges, moved.refs)))
        still = names.join(moved.refs, "dag_id", "left_anti")
        current = materialise(moved.union(keep_dags(current, still)), "walk")
        budget = cut(
            budget.join(picked.select("dag_id", F.col("spent").alias("now")), "dag_id", "left").select(
                "dag_id", F.coalesce("now", "spent").alias("spent")
            ),
            "budget",
        )
        if options.every_step:
            emitted.append(_tagged(current, f"s{step}"))
    if not options.every_step:
        emitted.append(_tagged(current, "end"))
    return current, emitted


def _tagged(dag: HistoryDag, tag: str) -> HistoryDag:
    name = F.concat_ws("#", "dag_id", F.lit(tag))
    return HistoryDag(*(t.withColumn("dag_id", name) for t in (dag.nodes, dag.edges, dag.refs)))


def fan_out(dag: HistoryDag, trees: HistoryDag, max_moves: int) -> HistoryDag:
    """Merge the best improving moves of drifted trees into the DAG."""
    index = spr.index_dag(trees)
    moves = cut(_named(_best_moves(spr.find_moves(index, max(2 * index.tree.max_depth, 1)), max_moves)), "moves")
    if moves.isEmpty():
        return dag
    return merge_all([dag, spr.apply_moves(trees, moves), trees])


def drift(dag: HistoryDag, options: SearchOptions) -> tuple[HistoryDag, bool]:
    """Leave a plateau: random walks, then scoring around where they end.

    ``legacy`` merges only the fan-out around the end, ``inplace`` only the walk,
    the combined modes both; ``combine-lwf`` emits every step of the walk.
    ``auto`` walks first and fans out when that did not lower the optimum.
    """
    start = objective(dag, options)
    mode = options.drift_mode
    for i in range(options.drift_rounds):
        seed = options.drift_seed + i
        trees = sample_trees(dag, 1, seed, options.method, options.uniform, options.model)
        walk_options = replace(options.drift_walk, every_step=options.drift_walk.every_step or mode == "combine-lwf")
        end, emitted = walk(trees, walk_options, seed)
        if mode != "legacy":
            dag = merge_all([dag, *emitted])
        lower = mode != "legacy" and objective(dag, options) < start
        if mode != "inplace" and not (mode == "auto" and lower):
            dag = fan_out(dag, end, options.max_moves)
        if objective(dag, options) < start:
            return dag, True
    return dag, False


def optimise(dag: HistoryDag, options: SearchOptions) -> tuple[HistoryDag, list[float]]:
    """The searched DAG and the objective after each iteration.

    Alternatives of the input that miss leaves of their clade are trimmed first.
    """
    dag = merge.merge(materialise(as_strings(dag), "input"), own_dag(), consistent=False)
    relative = 0.0 if options.method.startswith("parsimony") else 1e-10
    patience, history = Patience(options.patience, relative), []
    for i in range(options.iterations):
        dag = search_round(dag, options, options.seed + 1000 * i)
        history.append(objective(dag, options))
        if patience.done(history[-1]):
            if not options.drift_rounds:
                break
            dag, escaped = drift(dag, options)
            if not escaped:
                break
            patience.idle = 0
    dag = trim.trim_inconsistent(dag)[0]
    if options.trim:
        levels, ops = weigh(dag, options.method, options.model)
        dag = trim.trim_to_best(dag, dp.below(levels, ops))
    return dag, history


def metrics(dag: HistoryDag, model=None) -> DataFrame:
    """One row per DAG: size, tree count, range of parsimony, optimal trees, range of RF sums."""
    levels = rank_edges(dag)
    trees = dp.below(levels, sr.TreeCount()).top.select("dag_id", F.col("n").alias("trees"))
    best = dp.below(levels, sr.BestCount()).top.select(
        "dag_id", F.col("w").alias("least_mutations"), F.col("n").alias("optimal_trees")
    )
    most = dp.below(levels, sr.BestWeight(largest=True)).top.select("dag_id", F.col("w").alias("most_mutations"))
    weighted, shift = rf_levels(dag)
    lo = dp.below(weighted, rf.best_sum_rf()).top.select("dag_id", F.col("w").alias("lo"))
    hi = dp.below(weighted, rf.best_sum_rf(True)).top.select("dag_id", F.col("w").alias("hi"))
    out = trees.join(best, "dag_id").join(most, "dag_id").join(
        lo.join(hi, "dag_id").join(shift, "dag_id").select(
            "dag_id", (F.col("lo") + F.col("shift")).alias("least_rf_sum"), (F.col("hi") + F.col("shift")).alias("most_rf_sum")
        ),
        "dag_id",
    )
    if model is not None:
        out = out.join(best_score(dag, "ml", model).select("dag_id", F.col("w").alias("least_nll")), "dag_id")
    return out


def counts(dag: HistoryDag) -> DataFrame:
    """(dag_id, nodes, leaves, edges, depth)."""
    n = dag.nodes.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "leaf").alias("leaves")
    )
    e = dag.edges.groupBy("dag_id").agg(F.count(F.lit(1)).alias("edges"))
    d = depths(dag).groupBy("dag_id").agg(F.max("depth").alias("depth"))
    return n.join(e, "dag_id", "left").join(d, "dag_id", "left")
