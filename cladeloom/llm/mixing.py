"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.common import body, id_key, word_count
from cladeloom.runtime import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: A source gives at most so many times its size, in so many passes.
PASSES = 2
#: The mix has this many slots at least, and no slot of more words than MOST.
SLOTS, MOST = 65536, 1_000_000
#: Golden ratio's fraction over 2^32: slot k lies at k * GOLDEN mod 2^32.
GOLDEN = 2654435769
#: Cuts of the unit interval for the interval join, and slots ranked together.
CUTS, RUN = 1024, 4096


def block_words(total: int, share: float = SHARE) -> int:
    """Words of one slot for a corpus of ``total`` words."""
    return max(1, min(MOST, int(share * total) // SLOTS))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, i, source_size, target, low, high) from (source, source_size).

    Sources in code point order, null last, take the weights in turn.  A target
    that its cap stops leaves its excess to the others by weight: with sources
    in order of cap over weight, the common rate is the largest of what is left
    over the weights that are left.  ``low`` and ``high`` are the source's part
    of the unit interval.  One row per source; windows run over sources only.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("i") % len(weights) + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * passes).cast("double"))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    before = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("rate", left / heavy).withColumn("rate", F.max("rate").over(everything))
    s = s.withColumn("target", F.least("cap", F.col("rate") * F.col("w")))
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(everything)
    s = s.withColumn("upto", F.sum("target").over(upto)).withColumn("whole", whole)
    return s.select(
        "source", "i", "source_size", "target",
        F.coalesce(F.try_divide(F.lag("upto", 1, 0.0).over(Window.orderBy("i")), "whole"), F.lit(0.0)).alias("low"),
        F.coalesce(F.try_divide("upto", "whole"), F.lit(0.0)).alias("high"),
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, i, block): which block of which source stands at each slot.

    Slot k's golden-ratio point falls into one source's part of the unit
    interval; the join runs on equal cuts of the interval.  A source's slots are
    ranked in runs, each offset by the counts of the runs before it.
    """
    spark = sources.sparkSession
    point = ((F.col("id") * F.lit(GOLDEN)) % F.lit(2**32)).cast("double") / F.lit(float(2**32))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), point.alias("u"), F.floor(point * CUTS).cast("int").alias("cell")
    )
    parts = sources.where("high > low").select(
        "i", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CUTS).cast("int"), F.floor(F.col("high") * CUTS).cast("int"))).alias("cell"),
    )
    placed = points.join(parts, "cell").where("low <= u and u < high").select(
        "slot", "i", F.floor(F.col("slot") / RUN).alias("run")
    )
    runs = placed.groupBy("i", "run").agg(F.count(F.lit(1)).alias("n")).select(
        "i", "run", (F.sum("n").over(Window.partitionBy("i").orderBy("run")) - F.col("n")).alias("first")
    )
    nth = F.row_number().over(Window.partitionBy("i", "run").orderBy("slot")) - 1
    return placed.withColumn("nth", nth).join(runs, ["i", "run"]).select(
        "slot", "i", (F.col("first") + F.col("nth")).alias("block")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights=WEIGHTS, share: float = SHARE, passes: int = PASSES,
) -> DataFrame:
    """(doc_id, source, start, size, source_size, target, pass, block, from_word, words, slot).

    A source's documents, in the order of their ids' MD5, form a stream of
    words that is read ``passes`` times and cut into equal blocks; the r-th
    slot of a source takes its r-th block.  Each row is the part of a document
    that lies in one block; ``slot`` is null where the mix ends before it.  A
    document without words has one row of no words.

    Null texts have no words; null sources are one source, the last; null ids
    are one id.  Rows that repeat are documents of their own.  The result is a
    function of the rows alone, so reruns agree.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(body(text_col)).alias("size"), F.md5(id_key(id_col)).alias("h"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    words = block_words(total, share)
    sources = cut(targets(sizes, weights, share, passes), "mix-sources")
    slots = schedule(sources, math.ceil(share * total / words))

    named = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.h", "s.i", "s.source_size", "s.target",
        F.substring("d.h", 1, 3).alias("part"),
    )
    parts = named.groupBy("i", "part").agg(F.sum("size").alias("n")).select(
        "i", "part", (F.sum("n").over(Window.partitionBy("i").orderBy("part")) - F.col("n")).alias("first")
    )
    along = Window.partitionBy("i", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    stream = named.withColumn("upto", F.sum("size").over(along)).join(parts, ["i", "part"]).select(
        "doc_id", "source", "i", "size", "source_size", "target",
        (F.col("first") + F.col("upto") - F.col("size")).alias("start"),
    )

    def blocks(p):
        at = F.col("start") + F.col("source_size") * p
        return F.transform(
            F.sequence(F.floor(at / words), F.floor((at + F.col("size") - 1) / words)),
            lambda b: F.struct(
                p.alias("pass"), b.alias("block"),
                (F.greatest(at, b * words) - at).alias("from_word"),
                (F.least(at + F.col("size"), (b + 1) * words) - F.greatest(at, b * words)).alias("words"),
            ),
        )

    pieces = F.flatten(F.transform(F.array(*[F.lit(p).cast("bigint") for p in range(passes)]), blocks))
    return (
        stream.select("*", F.explode_outer(F.when(F.col("size") > 0, pieces)).alias("piece"))
        .select("doc_id", "source", "i", "start", "size", "source_size", "target", "piece.*")
        .join(slots, ["i", "block"], "left")
        .select("doc_id", "source", "i", "start", "size", "source_size", "target", "pass", "block", "from_word",
                F.coalesce("words", F.lit(0)).cast("bigint").alias("words"), "slot")
    )


def taken(pieces: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words the mix takes of each document.

    A document with words has its own start in its source; those without words
    may agree in all columns and are counted.
    """
    rows = F.when(F.col("size") > 0, 1).otherwise(F.count(F.lit(1)))
    return (
        pieces.groupBy("i", "start", "doc_id", "size", "source_size", "target")
        .agg(
            F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).cast("bigint").alias("taken"),
            rows.alias("rows"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
        .drop("col")
    )
