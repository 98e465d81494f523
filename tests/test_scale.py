"""What keeps jobs within their limits on large tables: each step once, small tasks, few joins."""

import re

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import levels as lv
from cladeloom.operators import validate
from cladeloom.operators import semiring as sr
from cladeloom.operators import dp
from cladeloom.plans import catalog, merge_queries, tables
from cladeloom.schema import HistoryDag

SF = "/root/testdata/sf0.001"


@pytest.fixture
def peeled(monkeypatch):
    """Names of the graphs peeled for ranks."""
    names, peel = [], lv._peel
    monkeypatch.setattr(lv, "_peel", lambda arcs, start, name: names.append(name) or peel(arcs, start, name))
    return names


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_looked_up_for_inner_nodes_only(spark, monkeypatch):
    kept, cut = {}, lv.cut
    monkeypatch.setattr(lv, "cut", lambda df, name, *a: kept.setdefault(name, cut(df, name, *a)))
    edges = spark.createDataFrame([("d", "u", "r"), ("d", "r", "a"), ("d", "r", "b"), ("d", "a", "c")], "dag_id string, parent_id string, child_id string")
    nodes = spark.createDataFrame([("d", n) for n in "urabc"], "dag_id string, node_id string")
    ranked = lv.rank_edges(HistoryDag(nodes, edges, nodes)).ranked
    assert {r["node_id"] for r in kept["height"].collect()} == {"u", "r", "a"}
    got = {(r["parent_id"], r["child_id"], r["parent_rank"], r["child_rank"]) for r in ranked.collect()}
    assert got == {("u", "r", 3, 2), ("r", "a", 2, 1), ("r", "b", 2, 0), ("a", "c", 1, 0)}


def test_trimming_the_merge_ranks_it_once(spark, peeled):
    catalog.QUERIES["trimmed_optimum_edges"](spark, SF)
    assert peeled == ["heights"]


def test_trimming_rounds_share_ranks_and_leaf_bits(spark, peeled):
    got = catalog.QUERIES["trim_rounds"](spark, SF)
    assert peeled == ["heights"]
    assert got.selectExpr("sum(edges_removed) n").first()["n"] > 0  # so there was a second round


def test_trimmed_edges_keep_their_columns(spark):
    dag = merge_queries._gappy_dags(spark, SF)
    out = merge_queries.trim.trim_inconsistent(dag)[0]
    assert out.edges.columns == dag.edges.columns and out.nodes.columns == dag.nodes.columns


def test_edge_checks_do_not_join_edges_with_nodes(spark):
    nodes = spark.createDataFrame([("d", "u", "ua"), ("d", "a", "leaf"), ("d", "b", "inner")], "dag_id string, node_id string, kind string")
    edges = spark.createDataFrame(
        [("d", "u", "b", 0), ("d", "b", "a", 0), ("d", "a", "u", 0), ("d", "a", "x", 0), ("d", "y", "x", 0), ("d", "b", None, 0)],
        "dag_id string, parent_id string, child_id string, clade_index int",
    )
    report = validate.edge_checks(HistoryDag(nodes, edges, nodes.select("dag_id").distinct()))
    got = sorted(((r["check"], r["node_id"] or "") for r in report.collect()))
    assert got == [(2, "u"), (3, ""), (3, "x"), (3, "x"), (3, "y"), (4, "a")]
    assert len(re.findall(r"Join", plan(report))) <= 2  # of the refs alone


@pytest.mark.parametrize("name", ["optimal_tree_count_per_customer", "optimal_uniform_sample"])
def test_counts_of_best_trees_are_hashed_in_small_tasks(spark, monkeypatch, name):
    monkeypatch.setattr("cladeloom.runtime.TASK_ROWS", 300)
    forest = tables.dealt_forest(spark, SF)
    lines = forest.levels[0].edges
    assert forest.tasks == -(-lines.count() // 300)
    res = dp.below(forest, sr.BestCount(F.col("edge_weight")))
    assert res.clade_parts[0].rdd.getNumPartitions() == forest.tasks
    assert "SortAggregate" not in plan(res.clade_parts[0])
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, SF))


def test_penalties_meet_their_lines_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr("cladeloom.runtime.TASK_ROWS", 300)
    tasks = tables.dealt_forest(spark, SF).tasks
    text = plan(catalog.QUERIES["edge_penalties"](spark, SF))
    assert len(re.findall(rf"hashpartitioning\(ok#\d+L?, {tasks}\), REPARTITION_BY_NUM", text)) == 2
    assert not re.search(r"hashpartitioning\(lvl", text)
