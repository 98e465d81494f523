"""Command-line jobs: ``cladeloom <job> ...`` or ``spark-submit cladeloom/plans/jobs.py <job> ...``.

On a cluster the workers need the package too: install it there, or pass a zip
of the ``cladeloom`` folder with ``--py-files``.

report    load DAGs, merge them, print counts, histogram or edge penalties,
          trim or sample, save
optimise  search for better trees, then trim or pick diverse trees, save
build     many FASTA files and a folder of Newick trees into one merged DAG
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

if not __package__:  # started as a file
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.operators import dp, merge, trim
from cladeloom.operators import semiring as sr
from cladeloom.operators.levels import rank_edges
from cladeloom.operators.models import load_model
from cladeloom.plans import search
from cladeloom.plans.options import DRIFT_MODES, ReportOptions, SearchOptions
from cladeloom.schema import HistoryDag
from cladeloom.sources import build, fasta, newick, proto, vcf


def load(spark: SparkSession, a) -> HistoryDag:
    """All inputs of a job as one container."""
    parts = []
    reference = fasta.read_reference(spark, a.reference) if a.reference else None
    if a.parquet:
        parts += [HistoryDag.read(spark, p) for p in a.parquet]
    if a.dag_pb:
        parts.append(proto.read_dag(spark, a.dag_pb))
    if a.tree_pb:
        parts.append(proto.read_parsimony(spark, a.tree_pb, reference))
    if a.fasta:
        parts.append(build.from_fasta_newick(spark, a.fasta, a.newick, reference, a.pattern))
    if not parts:
        raise SystemExit("no input given")
    # ids of merged DAGs are text, those of files numbers
    dag = search.plain_ids(reduce(HistoryDag.union, map(search.as_strings, parts)))
    if a.vcf:
        dag = vcf.overlay_genomes(dag, vcf.read_vcf(spark, a.vcf, reference))
    return dag


def save(dag: HistoryDag, path: str | None, scores=None) -> None:
    """Protobuf parts for a name ending in .pb or .pb.gz, Parquet otherwise."""
    if not path:
        return
    if path.endswith((".pb", ".pb.gz")):
        proto.write_dag(dag, path, path.endswith(".gz"), scores)
    else:
        dag.write(path)


def tell(df: DataFrame, name: str, a) -> None:
    """A report's first rows on the screen, all of it in a table if ``--reports`` names a folder."""
    if a.reports:
        df.write.mode("overwrite").parquet(f"{a.reports}/{name}")
        df = df.sparkSession.read.parquet(f"{a.reports}/{name}")
    df.show(truncate=False)


def merged(dag: HistoryDag) -> HistoryDag:
    return merge.merge(dag, consistent=False)


def report(spark: SparkSession, a) -> None:
    ReportOptions(a.edge_penalties, a.trim, a.sample)
    model = load_model(spark, a.model) if a.model else None
    dag = merged(load(spark, a))
    tell(search.counts(dag), "counts", a)
    if a.info:
        tell(search.metrics(dag, model), "metrics", a)
    if a.histogram:
        tell(dp.below(rank_edges(dag), sr.Histogram()).top.orderBy("dag_id", "w"), "histogram", a)
    scores = None
    if a.edge_penalties:
        levels, ops = search.weigh(dag, a.edge_penalties, model)
        below = dp.below(levels, ops)
        rel = 1e-8 if a.edge_penalties == "ml" else None
        pen = dp.edge_penalties(below, dp.above(below).edges, rel)
        tell(dp.penalty_summary(pen, ["dag_id"]), "penalties", a)
        scores = pen.select("dag_id", "edge_id", F.col("penalty").cast("double").alias("score"))
    if a.trim:
        levels, ops = search.weigh(dag, a.trim, model)
        dag = trim.trim_to_best(dag, dp.below(levels, ops))
    if a.sample:
        dag = search.sample_trees(dag, 1, a.seed, a.sample, a.uniform, model)
        tell(search.tree_scores(dag), "scores", a)
    save(dag, a.output, scores)


def optimise(spark: SparkSession, a) -> None:
    model = load_model(spark, a.model) if a.model else None
    options = SearchOptions(
        iterations=a.iterations, max_moves=a.max_moves, max_radius=a.max_radius, method=a.method,
        uniform=a.uniform, seed=a.seed, score_coeff=a.score_coeff, node_coeff=a.node_coeff,
        likelihood_coeff=a.likelihood_coeff, model=model, patience=a.patience,
        sample_per_radius=a.sample_per_radius, strategy=a.strategy, drift_rounds=a.drift_rounds,
        drift_mode=a.drift_mode, trim=a.trim, diverse=a.diverse, pool=a.pool,
        subtree_leaves=tuple(a.subtree_leaves) if a.subtree_leaves else None,
    )
    dag, history = search.optimise(load(spark, a), options)
    for i, value in enumerate(history, 1):
        print(f"iteration {i}: {value:g}")
    tell(search.counts(dag), "counts", a)
    if options.diverse:
        chosen, pool = search.diverse_trees(dag, options.diverse, options.pool, options.seed)
        tell(chosen, "diverse", a)
        newick.write_newick(search.keep_dags(pool, chosen.select(F.col("tree").alias("dag_id"))), a.output)
    else:
        save(dag, a.output)


def build_merged(spark: SparkSession, a) -> None:
    save(merged(load(spark, a)), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description="history DAG jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, run in (("report", report), ("optimise", optimise), ("build", build_merged)):
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        for many in ("parquet", "dag-pb", "tree-pb", "fasta", "newick", "vcf"):
            p.add_argument(f"--{many}", action="append")
        p.add_argument("--reference")
        p.add_argument("--pattern", help="file name pattern of the Newick files")
        p.add_argument("--output")
        p.add_argument("--reports", help="folder for the whole reports as Parquet tables")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--uniform", action="store_true")
        p.add_argument("--model", help="path prefix of a model's .yml and -libtorch.pth")
        if name == "report":
            p.add_argument("--info", action="store_true")
            p.add_argument("--histogram", action="store_true")
            for what in ("edge-penalties", "trim", "sample"):
                p.add_argument(f"--{what}")
        if name == "optimise":
            d = SearchOptions()
            for what in ("iterations", "max_moves", "max_radius", "score_coeff", "node_coeff", "drift_rounds", "diverse", "pool"):
                p.add_argument(f"--{what.replace('_', '-')}", type=int, default=getattr(d, what))
            p.add_argument("--patience", type=int)
            p.add_argument("--likelihood-coeff", type=float, default=0.0)
            p.add_argument("--method", default=d.method)
            p.add_argument("--strategy", default=d.strategy, choices=("native", "random"))
            p.add_argument("--drift-mode", default=d.drift_mode, choices=DRIFT_MODES)
            p.add_argument("--subtree-leaves", type=int, nargs=2)
            p.add_argument("--sample-per-radius", action="store_true")
            p.add_argument("--trim", action="store_true")
    return top


def main(argv=None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"cladeloom-{a.job}").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
