"""History DAGs derived from business tables.

* orders forest: customer -> order -> line.  A clade of a customer is an order
  priority, a clade of an order a return flag; rows of one clade are
  alternatives.
* grouping trees: per region several trees over the same customers, region ->
  nation -> group -> customer, that differ in how customers are grouped.
* heap tree: customers numbered into one binary tree; a deep bifurcating tree
  with a sequence at every leaf.
* sequences: a 32-letter string per key.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.operators.levels import EdgeLevels, Level, layered
from cladeloom.runtime import cut, spread, tasks_for
from cladeloom.schema import GENOME, HistoryDag

LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGT")
SEQ_LEN = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_of(key: Column) -> Column:
    return F.translate(F.md5(key.cast("string")), *LETTERS)


def reference() -> Column:
    return sequence_of(F.lit("ref"))


def line_edges(spark, sf_dir) -> DataFrame:
    """Order -> line edges; clades A, N, R numbered 0..2."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(
        F.col("l_orderkey").alias("parent_id"),
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("child_id"),
        flag.alias("clade_index"),
        F.col("l_quantity").cast("bigint").alias("edge_weight"),
        F.col("l_linenumber").cast("bigint").alias("line_number"),
        F.col("l_discount").alias("discount"),
    )


def order_edges(spark, sf_dir) -> DataFrame:
    """Customer -> order edges; clades by priority 1..5 numbered 0..4."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("parent_id"),
        F.col("o_orderkey").alias("child_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("clade_index"),
        F.lit(1).cast("bigint").alias("edge_weight"),
        F.lit(1).cast("bigint").alias("line_number"),
        F.lit(0.0).alias("discount"),
    )


def orders_forest(spark, sf_dir) -> EdgeLevels:
    """Two strict levels; node ids are unique per level, so no dag_id is needed."""
    return layered(
        Level(line_edges(spark, sf_dir), "leaf"), Level(order_edges(spark, sf_dir), "inner")
    )


def dealt_forest(spark, sf_dir) -> EdgeLevels:
    """``orders_forest`` for programs with wide rows: a task holds about as many lines in any table.

    An order has few lines and a customer few orders, so both may be dealt by parent.
    """
    lines = table(spark, sf_dir, "lineitem").count()
    return replace(orders_forest(spark, sf_dir), tasks=tasks_for(spark, lines))


def customer_groups(spark, sf_dir, trees: str = "ABCD") -> DataFrame:
    """(rk, nk, t, grp, k): which group each tree puts a customer in."""
    c = spread(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), "c_mktsegment", "c_acctbal"
    ))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk")
    )
    ways = {
        "A": F.col("c_mktsegment"),
        "B": (F.col("k") % 5).cast("string"),
        "C": F.floor(F.col("c_acctbal") / 2500).cast("string"),
        "D": F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(F.col("c_mktsegment")),
    }
    arms = F.array(*[F.struct(F.lit(t).alias("t"), ways[t].alias("grp")) for t in trees])
    return (
        c.join(n, "nk").select("rk", "nk", "k", F.explode(arms).alias("a"))
        .select("rk", "nk", "k", "a.t", "a.grp")
    )


def _tree_ids(g: DataFrame) -> DataFrame:
    dag = F.concat_ws("/", F.col("rk").cast("string"), "t")
    nation = F.concat(F.lit("n"), F.col("nk").cast("string"))
    return g.select(
        "*", dag.alias("dag_id"), nation.alias("nation_id"),
        F.concat_ws("/", nation, "grp").alias("group_id"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("leaf_id"),
    )


def grouping_trees(spark, sf_dir, trees: str = "ABCD", fragments: str = ""):
    """(HistoryDag, EdgeLevels) of the trees; edge weight = k % 7 + tree number.

    Trees named in ``fragments`` lose everything above their groups, and their
    group genomes differ from the other trees'.
    """
    g = _tree_ids(customer_groups(spark, sf_dir, trees))
    weight = (F.col("k") % 7 + F.ascii("t") - F.ascii(F.lit("A"))).cast("double")
    full = ~F.col("t").isin(*fragments) if fragments else F.lit(True)
    leaf = g.select(
        "dag_id", F.col("group_id").alias("parent_id"), F.col("leaf_id").alias("child_id"),
        F.col("k").cast("string").alias("clade_index"), weight.alias("edge_weight"),
        F.col("leaf_id").alias("leaf_name"),
    )
    group_rows = cut(g.select("rk", "nk", "t", "grp", "dag_id", "nation_id", "group_id").distinct(), "groups")
    no_name = F.lit(None).cast("string").alias("leaf_name")
    group = group_rows.where(full).select(
        "dag_id", F.col("nation_id").alias("parent_id"), F.col("group_id").alias("child_id"),
        F.col("grp").alias("clade_index"), F.lit(1.0).alias("edge_weight"), no_name,
    )
    nation_rows = group_rows.where(full).select("rk", "nk", "t", "dag_id", "nation_id").distinct()
    nation = nation_rows.select(
        "dag_id", F.lit("root").alias("parent_id"), F.col("nation_id").alias("child_id"),
        F.col("nk").cast("string").alias("clade_index"), F.lit(2.0).alias("edge_weight"), no_name,
    )
    dag_rows = nation_rows.select("dag_id").distinct()
    ua = dag_rows.select(
        "dag_id", F.lit("ua").alias("parent_id"), F.lit("root").alias("child_id"),
        F.lit("0").alias("clade_index"), F.lit(3.0).alias("edge_weight"), no_name,
    )
    none = F.array().cast(GENOME)
    marked = F.when(
        ~full, F.array(F.struct(F.lit(1).alias("pos"), F.lit("C").alias("base"))).cast(GENOME)
    ).otherwise(none)

    def inner(df, node, cg=none):
        return df.select(
            "dag_id", F.col(node).alias("node_id"), F.lit("inner").alias("kind"),
            F.lit(None).cast("string").alias("sample_id"), cg.alias("cg"),
        )

    nodes = (
        g.select("dag_id", F.col("leaf_id").alias("node_id"), F.lit("leaf").alias("kind"),
                 F.col("leaf_id").alias("sample_id"), none.alias("cg"))
        .unionByName(inner(group_rows, "group_id", marked))
        .unionByName(inner(nation_rows, "nation_id"))
        .unionByName(inner(dag_rows.withColumn("r", F.lit("root")), "r"))
        .unionByName(
            dag_rows.select("dag_id", F.lit("ua").alias("node_id"), F.lit("ua").alias("kind"),
                            F.lit(None).cast("string").alias("sample_id"), none.alias("cg"))
        )
    )
    refs = group_rows.select("dag_id").distinct().select(
        "dag_id", F.lit("ref").alias("reference_id"), reference().alias("reference_seq")
    )
    levels = layered(
        Level(leaf, "leaf"), Level(group, "inner"), Level(nation, "inner"), Level(ua, "inner"),
        keys=("dag_id",), cut_every=1,
    )
    edges = leaf.unionByName(group).unionByName(nation).unionByName(ua)
    return HistoryDag(nodes, edges, refs), levels


def region_of() -> Column:
    return F.substring_index("dag_id", "/", 1).cast("int")


def heap_tree(spark, sf_dir):
    """(nodes, max_depth): node_id 1.. in heap order, parent_id, depth, n_children.

    Customer k is heap node k + 1; node i has children 2i and 2i + 1.
    """
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("node_id"))
    last = c.agg(F.max("node_id")).first()[0]
    depth = F.length(F.bin("node_id")) - 1
    kids = F.when(F.col("node_id") * 2 + 1 <= last, 2).when(F.col("node_id") * 2 <= last, 1).otherwise(0)
    nodes = c.select(
        "node_id",
        F.when(F.col("node_id") > 1, F.shiftright("node_id", 1)).alias("parent_id"),
        depth.cast("int").alias("depth"),
        kids.cast("bigint").alias("n_children"),
    )
    return nodes, last.bit_length() - 1
