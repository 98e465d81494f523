"""The operators applied to the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm import collocations, conversation_repair, decontaminate, exact_dedup, html_extract, hyperminhash, language_id, license_scan, mixing, secret_scan, sharding, simhash, substring_dedup
from cladeloom.llm.common import table
from cladeloom.llm.sql import ORACLES  # noqa: F401


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(
        F.filter("base_spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))
    ).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secret_scan.BASE],
        F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.listed(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.coverage", "leak.slots", "leak.changed"
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.accepted"
    )


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_groups(table(spark, sf_dir, "documents"))
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))[0]


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "main.text", "main.n_chars")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op11_hyperminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damaged(talks))
    return conversation_repair.with_untouched(talks, repaired)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_source_mix": op3_source_mix,
    "op4_language_id": op4_language_id,
    "op5_jump_shards": op5_jump_shards,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hyperminhash_groups": op11_hyperminhash_groups,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
