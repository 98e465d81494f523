"""Exact dedup: 128-bit content hash, one kept row, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Rows are grouped by the MD5 of the whole text together with the text, so two
    texts that share a hash are never one group; the grouping is reduced before
    it is shuffled, and a text with very many copies leaves each task as one row.
    Members find their group by MD5 and SHA-256 over narrow rows.

    A null text counts as empty.  ``keep_id`` is the smallest or largest id of
    the group, null ids last (a group of null ids keeps a null id).  Of rows that
    repeat the kept id exactly one is kept, so a group always keeps one row.
    Other columns are ignored; an empty table gives no rows.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("body"))
    digests = rows.select(
        "doc_id", F.unhex(F.md5("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")
    )
    groups = (
        rows.groupBy(F.unhex(F.md5("body")).alias("h"), "body")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    members = digests.groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("copies"))
    return (
        members.join(groups, ["h", "sha"])
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
