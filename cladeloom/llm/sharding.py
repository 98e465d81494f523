"""Sharding by jump consistent hashing of stable keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.common import body, id_key

#: Fixed values of jump consistent hashing: the multiplier of its generator, and
#: the scale of the 31 bits that a jump uses.
MULTIPLIER = Decimal(2862933555777941757)
SCALE = 2147483648.0
#: Bytes that a stored row takes besides its text.
ROW_BYTES = 16
#: Jumps that are tried before the rare long chains are finished.
FIRST_JUMPS = 48


def key64(key: str | Column) -> Column:
    """The first 64 bits of a key's MD5 as an unsigned decimal."""
    return F.conv(F.substring(F.md5(id_key(key)), 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """struct(key, b, j): the chain of jumps up to the first that leaves ``shards``.

    ``b`` is the shard.  ``j`` is where the chain lands next, so with one shard
    more a row stays at ``b`` unless ``j`` is the new shard.
    """
    start = F.struct(
        key.alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")
    )

    def hop(s, _):
        k = ((s["key"] * F.lit(MULTIPLIER) + F.lit(Decimal(1))) % F.lit(Decimal(2**64))).cast("decimal(20,0)")
        r = F.call_function("div", k, F.lit(Decimal(2**33))).cast("double")
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(SCALE) / (r + 1.0))).cast("bigint")
        return F.when(s["j"] >= shards, s).otherwise(
            F.struct(k.alias("key"), s["j"].alias("b"), to.alias("j"))
        )

    def chain(s, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s, hop)

    first = chain(start, min(shards, FIRST_JUMPS))
    if shards <= FIRST_JUMPS:  # every jump moves on by one shard at least
        return first
    return F.transform(F.array(first), lambda s: F.when(s["j"] >= shards, s).otherwise(chain(s, shards)))[0]


def place(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text_col: str = "text", blocks: int = 1024
) -> DataFrame:
    """(row, key, size, text_crc32, law, shard, slot, grown_shard), one per input row.

    ``row`` is the input row as a struct.  The key's MD5 and the number of shards
    decide the shard; ``grown_shard`` is the shard with one shard more and
    differs only for rows that move into it.  ``slot`` counts the rows of a shard
    from 0 without gaps.  Rows are ranked inside ``blocks`` hash blocks of each
    shard, and the counts of the blocks (shards x blocks rows) give each block
    its first slot, so no task sees more than one block of a shard.

    A null key is the empty key, a null text has no bytes.  Rows that agree in
    key and text share a block and take neighbouring slots.  An empty table gives
    no rows; other columns are only carried along.
    """
    text = body(text_col)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("key"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump(key64(key), shards).alias("jump"),
    ).select(
        "row", "key", "size", "text_crc32",
        F.col("jump.b").cast("int").alias("shard"),
        F.when(F.col("jump.j") == shards, shards).otherwise(F.col("jump.b")).cast("int").alias("grown_shard"),
        F.conv(
            F.substring(F.md5(F.concat_ws("/", id_key("key"), F.col("text_crc32").cast("string"))), 1, 8), 16, 10
        ).cast("bigint").alias("h"),
    ).withColumn("block", (F.col("h") % blocks).cast("int"))
    first = (
        rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "shard", "block",
            (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"),
        )
    )
    within = Window.partitionBy("shard", "block").orderBy("h", "key", "size", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(first, ["shard", "block"])
        .select(
            "row", "key", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("nth")).cast("bigint").alias("slot"), "grown_shard",
        )
    )


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text_col: str = "text", blocks: int = 1024) -> DataFrame:
    """The result of ``place`` without the rows, the key under its own name."""
    return place(docs, shards, key, text_col, blocks).drop("row").withColumnRenamed("key", key)
