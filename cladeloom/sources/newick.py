"""Newick trees as rows, and rows as Newick text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.bases import genome_string
from cladeloom.operators import dp
from cladeloom.operators.levels import rank_edges
from cladeloom.operators.semiring import Semiring
from cladeloom.schema import HistoryDag

TOKEN = re.compile(r"[(),;]|[^(),;]+")
LENGTH = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
ROWS = "dag_id string, node_id bigint, parent_id bigint, label string, branch_length double, clade_index int, preorder bigint"


def _add_nodes(text: str, parents: list, labels: list, lengths: list, clades: list, orders: list) -> int:
    """Appends a tree's nodes by post-order id, returns how many; preorder number -1 off the last node's tree.

    Branch lengths may carry a sign or exponent; blanks around labels are dropped.
    """
    base = node = len(labels)
    families: list = []
    open_kids: list = [[]]
    kids, label = None, ""
    for tok in TOKEN.findall(text):
        if tok == "(":
            open_kids.append([])
        elif tok in "),;":
            name, length = label.strip(), None
            if ":" in name:
                start, _, end = name.rpartition(":")
                if LENGTH.fullmatch(end):
                    name, length = start.strip(), float(end)
            if kids:
                for clade, kid in enumerate(kids):
                    parents[kid], clades[kid] = node - base, clade
            parents.append(None)
            labels.append(name)
            lengths.append(length)
            clades.append(0)
            families.append(kids)
            label = ""
            node += 1
            if tok == ";":
                break
            open_kids[-1].append(node - 1)
            kids = open_kids.pop() if tok == ")" else None
        else:
            label += tok
    if node == base:
        raise ValueError("no tree in a Newick text")
    orders += [-1] * (node - base)
    stack, order = [node - 1], 0
    while stack:
        node = stack.pop()
        orders[node] = order
        order += 1
        if families[node - base]:
            stack += families[node - base][::-1]
    return len(families)


def newick_rows(text: str):
    """(id, parent, label, length, clade, preorder) per node, in preorder; ids in post-order."""
    columns: tuple = ([], [], [], [], [])
    _add_nodes(text, *columns)
    yield from sorted(((i, *row) for i, row in enumerate(zip(*columns)) if row[-1] >= 0), key=lambda row: row[-1])


def parse_newick(trees: DataFrame) -> DataFrame:
    """Node rows of ``trees`` (dag_id, newick), one Newick text per row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns: tuple = ([], [], [], [], [])
            sizes = [_add_nodes(text, *columns) for text in batch.column("newick").to_pylist()]
            sizes = np.array(sizes, dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = np.arange(len(columns[0])) - np.repeat(ends - sizes, sizes)
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64())
            rows = pa.RecordBatch.from_arrays(
                [batch.column("dag_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(ids),
                 *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=[c.split()[0] for c in ROWS.split(", ")],
            )
            stray = np.array(columns[-1], dtype=np.int64) < 0
            yield rows.filter(pa.array(~stray)) if stray.any() else rows

    return trees.select("dag_id", "newick").mapInArrow(run, ROWS)


def read_newick(spark: SparkSession, paths, pattern: str | None = None) -> DataFrame:
    """(dag_id, newick): whole files, ``dag_id`` = file path; ``pattern`` filters names."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("dag_id"), F.col("value").alias("newick")
    )


@dataclass(frozen=True)
class _Text(Semiring):
    values = ("text",)

    def leaf(self):
        return {"text": F.col("leaf_text")}

    def within(self, df, by):
        return df.groupBy(*by).agg(F.min("text").alias("text"))

    def between(self, df, by):
        parts = F.array_sort(F.collect_list(F.struct("clade_index", "text")))
        return df.groupBy(*by).agg(F.concat(F.lit("("), F.array_join(parts["text"], ","), F.lit(")")).alias("text"))


def to_newick(dag: HistoryDag) -> DataFrame:
    """(dag_id, newick) of trees; leaves by sample id, else by genome text.

    A tree's text is one value, so it has to fit a row.
    """
    uas = dag.nodes.where("kind = 'ua'").select("dag_id", F.col("node_id").alias("parent_id"))
    body = dag.edges.join(uas, ["dag_id", "parent_id"], "left_anti")
    name = F.coalesce(F.when(F.col("sample_id") != "", F.col("sample_id")), genome_string("cg"))
    leaf = dag.nodes.where("kind = 'leaf'").select(
        "dag_id", F.col("node_id").alias("child_id"), name.alias("leaf_text")
    )
    arcs = body.join(leaf, ["dag_id", "child_id"], "left").select(
        "dag_id", "parent_id", "child_id", "clade_index", "leaf_text"
    )
    inner = HistoryDag(dag.nodes.where("kind <> 'ua'"), dag.edges.join(uas, ["dag_id", "parent_id"], "left_anti"), dag.refs)
    res = dp.below(rank_edges(inner, arcs), _Text())
    return res.top.select("dag_id", F.concat("text", F.lit(";")).alias("newick"))


def write_newick(dag: HistoryDag, path: str) -> None:
    """One tree per line."""
    to_newick(dag).select("newick").write.mode("overwrite").text(path)
