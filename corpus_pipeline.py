"""A corpus pipeline: each stage applies one operator to all that the stage before kept.

Stages return the columns of their input, the last one with the shard beside
them.  They accept what the operators accept: null, empty and very long texts,
null ids, repeated rows, empty tables and further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm import decontaminate, language_id, mixing, near_dedup, sharding
from cladeloom.llm.common import body, id_key, table
from cladeloom.runtime import stage_path

SHARDS = 40


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects: texts without a letter, and those far from every learned language.

    Null and empty texts go; rows that repeat go or stay together.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return language_id.identify(rows, "row.doc_id", "row.text", "row.lang").where("language.accepted").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word similarity of 0.8 or more) the row of the smallest id.

    Null and empty texts are one group.  A row without an id stays only if no row
    of its group has one; of rows that repeat one stays.
    """
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, as it is or filled in anew.

    Null and empty texts stay; rows that repeat go or stay together.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), "row.text").where(F.size("leaks") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents as the mix takes them: a pass that takes half a document or more is a row.

    Documents without words are dropped, as no slot takes them.  Rows that agree
    in id, source and text share their passes evenly, rounded up.
    """
    key = F.md5(F.concat_ws("/", id_key("doc_id"), F.hex("source"), F.md5(body("text"))))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), "source", "text")
    taken = mixing.taken(mixing.mix(rows, id_col="key")).where("size > 0")
    passes = F.ceil(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)) / F.count(F.lit(1))).cast("int")
    kept = taken.groupBy(F.col("doc_id").alias("key")).agg(passes.alias("passes")).where("passes > 0")
    return rows.select("row", "key").join(kept, "key").select("row", F.explode(F.sequence(F.lit(1), "passes"))).select("row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each with ``placed``: struct<shard, slot, grown_shard, size>.

    Null ids share a shard; rows that repeat take neighbouring slots of one shard.
    """
    placed = F.struct("shard", "slot", "grown_shard", "size").alias("placed")
    return sharding.place(docs, SHARDS).select("row.*", placed)


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
    ("shard", assign_shards),
]

#: Character models and fingerprints are not for SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
