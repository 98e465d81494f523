"""FASTA and reference-sequence readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fasta_records(df: DataFrame, text: str = "value") -> DataFrame:
    """Split ``>name\\nbases...`` records; adds ``name`` and upper-case ``sequence``."""
    body = F.regexp_replace(F.col(text), r"^\s*>?", "")
    cut_at = F.instr(body, F.lit("\n"))
    head = F.when(cut_at > 0, F.substring(body, F.lit(1), cut_at - 1)).otherwise(body)
    rest = F.when(cut_at > 0, F.substring(body, cut_at + 1, F.length(body))).otherwise(F.lit(""))
    return (
        df.withColumn("name", F.trim(F.regexp_replace(head, "\r", "")))
        .withColumn("sequence", F.upper(F.regexp_replace(rest, r"\s+", "")))
        .where(F.col("name") != "")
    )


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """(path, block, at, name, sequence); (block, at) orders a file's records.

    Records are the split unit, so one large file is read by many tasks; gzip is
    recognised by extension.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths)
    raw = raw.select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    return parse_fasta_records(raw).select("path", "block", "at", "name", "sequence")


def last_by_name(records: DataFrame) -> DataFrame:
    """One sequence per name: the last file's, and within a file the last record's."""
    at = F.struct("path", "block", "at")
    return records.groupBy("name").agg(F.max_by("sequence", at).alias("sequence"))


def read_reference(spark: SparkSession, path: str) -> str:
    """A single reference: the first FASTA record, else the whole text without blanks."""
    first = spark.read.option("lineSep", "\n>").text(path).limit(1)
    is_fasta = F.col("value").startswith(">")
    parsed = parse_fasta_records(first)
    seq = parsed.select("sequence", is_fasta.alias("f")).first()
    if seq is not None and seq["f"]:
        return seq["sequence"]
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.upper(F.regexp_replace("value", r"\s+", ""))).first()[0]
