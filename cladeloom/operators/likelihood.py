"""Context-dependent mutation likelihood of edges.

A model gives every site of the parent sequence a mutation rate and, for each
base, the probability of mutating to it.  The log-likelihood of an edge with n
mutations is n*log(n / sum(rates)) - n plus the log of rate*probability at each
mutated site; an edge without mutations scores zero and is never sent to a model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.functions import bases
from cladeloom.schema import HistoryDag

# Fixed value: floor of a conditional substitution probability.
CSP_FLOOR = 1e-30
# Letters as 0..3, any other as 4.
CODES = np.full(256, 4, dtype=np.uint8)
CODES[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)
# Sites that a task holds in arrays at a time.
PASS_SITES = 1 << 20


def poisson_terms(n: Column, total_rate: Column, site_logs: Column) -> Column:
    """Log-likelihood from its three aggregates; zero without mutations."""
    bad = F.isnan(total_rate) | (total_rate <= 0) | (total_rate == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("mutation rates must be positive and finite")).cast("double"))
    value = n * F.log(n / total_rate) - n + site_logs
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(checked, value))


def edge_pairs(dag: HistoryDag, score_root_edges: bool = False) -> DataFrame:
    """Edges with ``parent_seq`` and ``child_seq``; root edges left out by default."""
    g = dag.nodes.select("dag_id", "node_id", "kind", "cg")
    ref = dag.refs.select("dag_id", "reference_seq")
    parent = g.withColumnsRenamed({"node_id": "parent_id", "cg": "parent_cg", "kind": "parent_kind"})
    child = g.drop("kind").withColumnsRenamed({"node_id": "child_id", "cg": "child_cg"})
    edges = dag.edges.select("dag_id", "edge_id", "parent_id", "child_id").join(
        parent, ["dag_id", "parent_id"]
    )
    if not score_root_edges:
        edges = edges.where(F.col("parent_kind") != "ua")
    return edges.join(child, ["dag_id", "child_id"]).join(ref, "dag_id").select(
        "dag_id", "edge_id", "parent_id", "child_id",
        bases.sequence_from_genome("parent_cg", "reference_seq").alias("parent_seq"),
        bases.sequence_from_genome("child_cg", "reference_seq").alias("child_seq"),
    )


def _letters(seqs, width: int) -> np.ndarray:
    """(sequence, site): upper-case letters of the first ``width`` sites, 0 beyond an end."""
    raw = np.array([s.encode("ascii", "replace")[:width] for s in seqs], dtype=f"S{width}")
    out = raw.view(np.uint8).reshape(len(raw), width)
    return out - 32 * ((out > 96) & (out < 123)).astype(np.uint8)


def _table_terms(parent, child, k: int, site_count: int, rates: np.ndarray, csp: np.ndarray):
    """(mutations, total rate, sum of site logs) per pair; ``csp`` is (kmer, parent base or 4, child base)."""
    ends = np.fromiter((min(len(p), len(c), site_count) for p, c in zip(parent, child)), int, len(parent))
    width, side = max(int(ends.max(initial=0)), 1), k // 2
    own, other = _letters(parent, width + side), _letters(child, width)
    codes = CODES[own]
    around = np.pad(codes, ((0, 0), (side, 0)), constant_values=4)
    kmer, known = np.zeros((len(own), width), dtype=np.int32), np.ones((len(own), width), dtype=bool)
    for i in range(k):
        at = around[:, i : i + width]
        kmer = kmer * 4 + at
        known &= at < 4
    kmer[~known] = 4**k
    site = (np.arange(width) < ends[:, None]) & ~np.isnan(rates[kmer])
    spot = np.nonzero(site & (own[:, :width] != other))
    to = CODES[other[spot]]
    if (to > 3).any():
        raise ValueError("mutated site with an unknown base")
    here = kmer[spot]
    odds = rates[here] * np.maximum(csp[here, codes[spot], to], CSP_FLOOR)
    logs = np.log(odds, out=np.zeros_like(odds), where=odds > 0)
    count = lambda w=None: np.bincount(spot[0], w, minlength=len(own))
    return count(), np.where(site, rates[kmer], 0.0).sum(axis=1), count(logs)


def kmer_table_loglik(pairs: DataFrame, table: DataFrame, k: int, site_count: int, rate_bias: float = 0.0) -> DataFrame:
    """(parent_seq, child_seq, loglik) under a k-mer table model.

    ``table``: (kmer, rate) plus ``csp`` (substitution odds of A, C, G, T) or
    ``logits``, whose softmax leaves out the parent's own base.  The model's
    4**k + 1 rows go to every task; sites of k-mers not in it do not count.
    Pairs are deduplicated, so a sequence pair shared by many edges is scored once.
    """
    todo = pairs.select("parent_seq", "child_seq").distinct()
    todo = todo.where(
        F.substring("parent_seq", 1, site_count) != F.substring("child_seq", 1, site_count)
    )
    rates, csp = np.full(4**k + 1, np.nan), np.zeros((4**k + 1, 5, 4))
    for row in table.collect():
        rates[row["kmer"]] = row["rate"] * np.exp(rate_bias)
        if "csp" in table.columns:
            csp[row["kmer"]] = row["csp"]
            continue
        weights = np.exp(np.array(row["logits"]) - max(row["logits"]))
        for base in range(5):
            csp[row["kmer"], base] = weights / np.delete(weights, base if base < 4 else []).sum()

    @F.pandas_udf("n long, total double, logs double")
    def terms(parent: pd.Series, child: pd.Series) -> pd.DataFrame:
        parent, child = list(parent), list(child)
        step = max(1, PASS_SITES // max(min(site_count, max(map(len, parent), default=1)), 1))
        parts = [
            _table_terms(parent[i : i + step], child[i : i + step], k, site_count, rates, csp) for i in range(0, len(parent), step)
        ]
        n, total, logs = map(np.concatenate, zip(*parts)) if parts else ([], [], [])
        return pd.DataFrame({"n": n, "total": total, "logs": logs})

    scored = todo.select("parent_seq", "child_seq", terms("parent_seq", "child_seq").alias("t"))
    return scored.select("parent_seq", "child_seq", poisson_terms(F.col("t.n"), F.col("t.total"), F.col("t.logs")).alias("loglik"))


def edge_nll(dag: HistoryDag, score, score_root_edges: bool = False) -> DataFrame:
    """(dag_id, edge_id, parent_id, child_id, nll); unchanged and skipped edges score 0.

    ``score`` maps (parent_seq, child_seq) rows to rows with ``loglik``.
    """
    pairs = edge_pairs(dag, score_root_edges)
    changed = pairs.where(F.col("parent_seq") != F.col("child_seq"))
    scored = pairs.join(score(changed), ["parent_seq", "child_seq"], "left")
    ids = ["dag_id", "edge_id", "parent_id", "child_id"]
    nll = scored.select(*ids, (-F.coalesce("loglik", F.lit(0.0))).alias("nll"))
    return dag.edges.select(*ids).join(nll, ids, "left").withColumn("nll", F.coalesce("nll", F.lit(0.0)))


def dag_nll(nll: DataFrame) -> DataFrame:
    return nll.groupBy("dag_id").agg(F.sum("nll").alias("nll"))
