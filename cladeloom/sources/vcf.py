"""VCF single-base variants as sample genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.functions.bases import ref_base
from cladeloom.operators.fitch import recompute_edges
from cladeloom.schema import GENOME, HistoryDag


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(path, at, sample, pos, base) calls of VCF ``lines`` (path, at, value).

    Only single-base REF and ALT rows count.  A call is the first digit of the
    genotype; a missing or unknown allele reads as REF.
    """
    line = F.regexp_replace("value", "\r$", "")
    cols = lines.where(~F.col("value").startswith("##") & (F.col("value") != "")).select(
        "path", "at", F.split(line, "\t").alias("c")
    )
    header = cols.where(F.col("c")[0] == "#CHROM").select(
        "path", F.slice("c", 10, F.size("c")).alias("samples")
    )
    rows = cols.where((F.col("c")[0] != "#CHROM") & (F.size("c") >= 10)).select(
        "path", "at", F.col("c")[1].try_cast("int").alias("pos"), F.upper(F.col("c")[3]).alias("ref"),
        F.split(F.upper(F.col("c")[4]), ",").alias("alts"), F.slice("c", 10, F.size("c")).alias("calls"),
    )
    snps = rows.where((F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1))
    called = snps.join(header, "path").select(
        "path", "at", "pos", "ref", "alts",
        F.explode(F.arrays_zip("samples", "calls")).alias("x"),
    ).where(F.col("x.samples").isNotNull() & F.col("x.calls").isNotNull())
    digit = F.coalesce(F.try_to_number(F.substring("x.calls", 1, 1), F.lit("9")).cast("int"), F.lit(0))
    base = F.when((digit > 0) & (digit <= F.size("alts")), F.try_element_at("alts", digit)).otherwise(F.col("ref"))
    return called.select("path", "at", F.col("x.samples").alias("sample"), "pos", base.alias("base"))


def sample_genomes(calls: DataFrame, reference) -> DataFrame:
    """(sample_id, cg): bases that differ from ``reference``; the last row of a site wins."""
    n = F.length(reference)
    pos = F.when(F.col("pos").between(1, n), F.col("pos")).otherwise(
        F.raise_error(F.lit("VCF position outside the reference")).cast("int")
    )
    kept = calls.withColumn("pos", pos).where(F.col("base") != ref_base(reference, F.col("pos")))
    last = kept.groupBy("sample", "pos").agg(F.max_by("base", F.struct("path", "at")).alias("base"))
    sites = F.array_sort(F.collect_list(F.struct("pos", "base"))).cast(GENOME)
    return last.groupBy(F.col("sample").alias("sample_id")).agg(sites.alias("cg"))


def read_vcf(spark: SparkSession, paths, reference: str) -> DataFrame:
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("at"), "value",
    )
    return sample_genomes(parse_vcf(lines), F.lit(reference))


def overlay_genomes(dag: HistoryDag, genomes: DataFrame) -> HistoryDag:
    """Leaf genomes overlaid with ``genomes`` (sample_id, cg); edges recomputed.

    Calls are differences from the reference they were read with.  One that is
    the DAG's own reference base at its site takes the leaf's mutation there away.
    """
    new = genomes.withColumnRenamed("cg", "vcf_cg")

    def as_map(c):
        return F.map_from_entries(c)

    merged = F.map_zip_with(
        as_map(F.col("cg")), as_map(F.coalesce("vcf_cg", F.array().cast(GENOME))),
        lambda _, old, fresh: F.coalesce(fresh, old),
    )
    entries = F.transform(F.map_entries(merged), lambda e: F.struct(e["key"].alias("pos"), e["value"].alias("base")))
    own = F.filter(entries, lambda e: e["base"] != ref_base(F.col("reference_seq"), e["pos"]))
    overlaid = (F.col("kind") == "leaf") & F.col("vcf_cg").isNotNull()
    nodes = dag.nodes.join(new, "sample_id", "left").join(dag.refs.select("dag_id", "reference_seq"), "dag_id", "left").withColumn(
        "cg", F.when(overlaid, F.array_sort(own).cast(GENOME)).otherwise(F.col("cg"))
    )
    return recompute_edges(dag.with_nodes(nodes.select(*dag.nodes.columns)))
