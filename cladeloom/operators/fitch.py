"""Fitch parsimony on trees: base sets up, base choice down, costs.

Rows are (node, word) with fifteen sites per word, and only words that differ
from the reference are kept: an absent row means "as the reference".  A level
therefore moves about as many rows as there are mutations, not nodes x sites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.functions import bases
from cladeloom.functions import sitewords as sw
from cladeloom.operators.levels import depths
from cladeloom.runtime import cut, materialise
from cladeloom.schema import GENOME, HistoryDag


@dataclass(frozen=True)
class Tree:
    """nodes: keys, node_id, parent_id (NULL at the root), depth, n_children."""

    nodes: DataFrame
    max_depth: int
    keys: tuple[str, ...] = ("dag_id",)
    cut_every: int = 1


def tree_of(dag: HistoryDag) -> Tree:
    """Rooted tree below each pseudo-root, ready for level-wise passes."""
    uas = dag.nodes.where(F.col("kind") == "ua").select("dag_id", F.col("node_id").alias("parent_id"))
    arcs = dag.edges.select("dag_id", "parent_id", F.col("child_id").alias("node_id"))
    inner = arcs.join(uas, ["dag_id", "parent_id"], "left_anti")
    size = inner.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    deep = depths(dag).where(F.col("depth") > 0)
    nodes = (
        deep.join(inner, ["dag_id", "node_id"], "left")
        .join(size, ["dag_id", "node_id"], "left")
        .select(
            "dag_id", "node_id", "parent_id", (F.col("depth") - 1).alias("depth"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
        )
    )
    nodes = cut(nodes, "tree", ("depth",))
    return Tree(nodes, nodes.agg(F.max("depth")).first()[0] or 0)


def variable_sites(dag: HistoryDag) -> DataFrame:
    """(dag_id, pos, site): positions at which any genome or edge varies, numbered."""
    from_genomes = dag.nodes.select("dag_id", F.explode("cg.pos").alias("pos"))
    from_edges = dag.edges.select("dag_id", F.explode("mutations.pos").alias("pos"))
    spots = from_genomes.unionByName(from_edges).distinct()
    # At most one row per genome position, so the window stays small.
    order = Window.partitionBy("dag_id").orderBy("pos")
    return spots.withColumn("site", F.row_number().over(order) - 1)


def _word(site) -> Column:
    return (F.col(site) / sw.SITES).cast("int")


def reference_words(dag: HistoryDag, sites: DataFrame) -> DataFrame:
    """(dag_id, word, ref): packed reference bases of the variable sites."""
    base = bases.base_mask(bases.ref_base("reference_seq", F.col("pos")))
    return (
        sites.join(dag.refs.select("dag_id", "reference_seq"), "dag_id")
        .select("dag_id", _word("site").alias("word"), sw.site_bits(base, F.col("site")).alias("b"))
        .groupBy("dag_id", "word")
        .agg(F.bit_or("b").alias("ref"))
    )


def genome_words(dag: HistoryDag, nodes: DataFrame, sites: DataFrame, refs: DataFrame, dense: bool) -> DataFrame:
    """(dag_id, node_id, word, bits, ref) of node genomes; dense keeps every word."""
    flat = nodes.select("dag_id", "node_id", F.explode("cg").alias("s")).select(
        "dag_id", "node_id", "s.pos", "s.base"
    )
    letter = bases.ref_base("reference_seq", F.col("pos"))
    flip = bases.base_mask("base").bitwiseXOR(bases.base_mask(letter))
    delta = (
        flat.join(sites, ["dag_id", "pos"])
        .join(dag.refs.select("dag_id", "reference_seq"), "dag_id")
        .select("dag_id", "node_id", _word("site").alias("word"), sw.site_bits(flip, F.col("site")).alias("b"))
        .groupBy("dag_id", "node_id", "word")
        .agg(F.bit_xor("b").alias("b"))
    )
    if dense:
        every = nodes.select("dag_id", "node_id").join(refs, "dag_id")
        delta = every.join(delta, ["dag_id", "node_id", "word"], "left")
    else:
        delta = delta.join(refs, ["dag_id", "word"])
    return delta.select(
        "dag_id", "node_id", "word",
        F.col("ref").bitwiseXOR(F.coalesce("b", F.lit(0).cast("bigint"))).alias("bits"), "ref",
    )


@dataclass(frozen=True)
class FitchSets:
    """Level parts, deepest first; ``inner`` rows carry ``set`` and ``cost``."""

    tree: Tree
    place: DataFrame
    inner_parts: tuple[DataFrame, ...]

    @property
    def inner(self) -> DataFrame:
        out = self.inner_parts[0]
        for p in self.inner_parts[1:]:
            out = out.unionByName(p)
        return out

    def cost(self) -> DataFrame:
        """(keys, cost): number of (node, site) pairs without a common base."""
        return self.inner.groupBy(*self.tree.keys).agg(F.sum("cost").alias("cost"))


def merge_children(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fitch sets of parents from the ``bits`` of their children."""
    merged = rows.groupBy(*by).agg(
        F.bit_and("bits").alias("both"),
        F.bit_or("bits").alias("either"),
        F.count(F.lit(1)).alias("seen"),
        F.any_value("ref").alias("ref"),
        F.any_value("siblings").alias("siblings"),
    )
    absent = F.col("seen") < F.col("siblings")
    inter = F.when(absent, F.col("both").bitwiseAND(F.col("ref"))).otherwise(F.col("both"))
    union = F.when(absent, F.col("either").bitwiseOR(F.col("ref"))).otherwise(F.col("either"))
    return (
        merged.withColumn("inter", inter)
        .withColumn("union_", union)
        .select(
            *by,
            sw.fitch_set(F.col("inter"), F.col("union_")).alias("set"),
            F.when(F.col("siblings") > 1, sw.empty_sites(F.col("inter"), F.col("union_")))
            .otherwise(0).cast("bigint").alias("cost"),
            "ref",
        )
    )


def sets_up(tree: Tree, leaves: DataFrame, dense: bool = False) -> FitchSets:
    """Bottom-up pass.  ``leaves``: keys, node_id, word, bits, ref."""
    keys = list(tree.keys)
    size = tree.nodes.select(
        *keys, F.col("node_id").alias("parent_id"), F.col("n_children").alias("siblings")
    )
    # Every level reads only its own partition of nodes and of leaf rows.
    place = tree.nodes.where("depth > 0").select(*keys, "node_id", "parent_id", "depth")
    place = cut(place.join(size, [*keys, "parent_id"]), "place", ("depth",))
    tips = cut(leaves.join(place, [*keys, "node_id"]).drop("node_id"), "tips", ("depth",))
    parts = []
    carried = None
    for i, d in enumerate(range(tree.max_depth, 0, -1), 1):
        arrive = tips.where(F.col("depth") == d).drop("depth")
        if carried is not None:
            at = place.where(F.col("depth") == d).drop("depth")
            arrive = arrive.unionByName(carried.join(at, [*keys, "node_id"]).drop("node_id"))
        done = merge_children(arrive, [*keys, "parent_id", "word"]).withColumnRenamed(
            "parent_id", "node_id"
        )
        if tree.cut_every and i % tree.cut_every == 0:
            done = cut(done, "fitch")
        parts.append(done)
        carried = done.select(*keys, "node_id", "word", F.col("set").alias("bits"), "ref")
        if not dense:
            carried = carried.where(F.col("bits") != F.col("ref"))
    return FitchSets(tree, place, tuple(parts))


def assign_down(sets: FitchSets, root_prefer: DataFrame | None = None) -> DataFrame:
    """Top-down pass: (keys, node_id, word, bits, ref) of inner nodes.

    A node keeps its parent's base where its set allows, else takes the lowest
    base of the set; the root prefers the reference, or ``root_prefer``
    (keys, word, prefer), the genome of a parent outside the tree.
    """
    tree = sets.tree
    keys = list(tree.keys)
    parts = []
    up = None
    for d in range(tree.max_depth):
        own = sets.inner_parts[tree.max_depth - 1 - d]
        if up is None:
            if root_prefer is None:
                want = own.withColumn("prefer", F.col("ref"))
            else:
                want = own.join(root_prefer, [*keys, "word"], "left")
        else:
            at = sets.place.where(F.col("depth") == d).drop("depth", "siblings")
            want = own.join(at, [*keys, "node_id"]).join(
                up.select(
                    *keys, F.col("node_id").alias("parent_id"), "word", F.col("bits").alias("prefer")
                ),
                [*keys, "parent_id", "word"], "left",
            )
        prefer = F.coalesce("prefer", "ref")
        up = want.select(*keys, "node_id", "word", sw.choose_base(F.col("set"), prefer).alias("bits"), "ref")
        if tree.cut_every and (d + 1) % tree.cut_every == 0:
            up = cut(up, "assign")
        parts.append(up)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def genomes_from_words(words: DataFrame, sites: DataFrame) -> DataFrame:
    """(dag_id, node_id, cg) from one-hot words; a genome is at most the sites."""
    spots = sites.withColumn("word", _word("site"))
    letter = sw.site_base(F.col("bits"), F.col("site"))
    return (
        words.where(F.col("bits") != F.col("ref"))
        .join(spots, ["dag_id", "word"])
        .where(letter != sw.site_base(F.col("ref"), F.col("site")))
        .groupBy("dag_id", "node_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("base")))).alias("cg"))
    )


def prepare(dag: HistoryDag, dense: bool = False):
    """(tree, sites, refs, leaf words) of a set of trees."""
    sites = cut(variable_sites(dag), "sites")
    refs = reference_words(dag, sites)
    leaves = dag.nodes.where(F.col("kind") == "leaf")
    words = cut(genome_words(dag, leaves, sites, refs, dense), "leafwords")
    return tree_of(dag), sites, refs, words


def recompute_edges(dag: HistoryDag) -> HistoryDag:
    """Edge mutations from the genomes at both ends."""
    g = dag.nodes.select("dag_id", "node_id", "cg")
    cols = [c for c in dag.edges.columns if c != "mutations"]
    edges = (
        dag.edges.drop("mutations")
        .join(g.withColumnsRenamed({"node_id": "child_id", "cg": "child_cg"}), ["dag_id", "child_id"])
        .join(g.withColumnsRenamed({"node_id": "parent_id", "cg": "parent_cg"}), ["dag_id", "parent_id"])
        .join(dag.refs.select("dag_id", "reference_seq"), "dag_id")
        .withColumn("mutations", bases.edge_mutations("parent_cg", "child_cg", "reference_seq"))
        .select(*cols, "mutations")
    )
    return dag.with_edges(edges)


def fitch_assign(dag: HistoryDag, root_parent: DataFrame | None = None) -> HistoryDag:
    """Reassign inner genomes of trees by Fitch parsimony and redo their edges.

    ``root_parent``: optional (dag_id, cg) of the genome above each tree root.
    """
    if root_parent is not None:
        above = root_parent.select("dag_id", F.lit(None).cast(dag.nodes.schema["node_id"].dataType).alias("node_id"), "cg")
        extra = dag.with_nodes(dag.nodes.unionByName(above, allowMissingColumns=True))
        sites = cut(variable_sites(extra), "sites")
        refs = reference_words(dag, sites)
        prefer = genome_words(dag, above, sites, refs, True).select(
            "dag_id", "word", F.col("bits").alias("prefer")
        )
        leaves = dag.nodes.where(F.col("kind") == "leaf")
        words = cut(genome_words(dag, leaves, sites, refs, True), "leafwords")
        tree = tree_of(dag)
        sets = sets_up(tree, words, dense=True)
        genomes = genomes_from_words(assign_down(sets, prefer), sites)
    else:
        tree, sites, refs, words = prepare(dag)
        genomes = genomes_from_words(assign_down(sets_up(tree, words)), sites)
    inner = F.col("kind") == "inner"
    fresh = genomes.withColumnRenamed("cg", "new_cg")
    nodes = dag.nodes.join(fresh, ["dag_id", "node_id"], "left").withColumn(
        "cg", F.when(inner, F.coalesce("new_cg", F.array().cast(GENOME))).otherwise(F.col("cg"))
    ).drop("new_cg")
    return materialise(recompute_edges(dag.with_nodes(cut(nodes, "assigned"))), "fitch")
