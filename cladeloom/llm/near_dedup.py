"""The near-dedup stage: SimHash shards as first cut, HyperMinHash bands for what they cannot reach, full sets decide.

Links at two differing bits hold few of the pairs of similarity 0.8: texts of
200 words with four changed differ by nine bits of 64 in the median and by 15 in
one of a hundred, a reach at which a vantage-point tree sends nearly everything
to both sides.  So operator 7's tree proposes the closest pairs, whose groups
need no further look, and bands of registers propose the others.  A pair counts
only if the full sets of both texts are similar enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm import hyperminhash, simhash

SHINGLE, PERCENT = 5, 80


def close_fingerprints(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of sets whose fingerprints the tree links, or that share one.

    ``sets`` is (skey, n, mark) with the fingerprint as mark.  The least set of a
    fingerprint stands for it, so each set and each link gives one pair.
    """
    head = sets.groupBy("mark").agg(F.min(F.struct("skey", "n")).alias("head"))
    fps = head.select(F.col("mark").alias("fp"))
    pair = lambda a, b: [F.col(f"{a}.skey").alias("a"), F.col(f"{b}.skey").alias("b"), F.col(f"{a}.n").alias("n_a"), F.col(f"{b}.n").alias("n_b")]
    same = sets.select("mark", F.struct("skey", "n").alias("own")).join(head, "mark").where("own.skey != head.skey")
    links = simhash.near_links(fps)
    far = links.join(head.select(F.col("mark").alias("a"), F.col("head").alias("x")), "a")
    far = far.join(head.select(F.col("mark").alias("b"), F.col("head").alias("y")), "b")
    return same.select(*pair("own", "head")).unionAll(far.select(*pair("x", "y")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    Two texts are near duplicates if the Jaccard similarity of their sets of
    five-word shingles is 0.8 or more, and so are those that others link.
    Null and empty texts are one group.  A row without an id stays only if its
    group has no id.  Of rows that agree in id and text the least one stays.
    """
    fingerprint = simhash.fingerprint_column(SHINGLE)

    def mark(text: Column) -> Column:
        return fingerprint(text)

    return hyperminhash.keep_one(docs, id_col, text_col, SHINGLE, PERCENT, mark, close_fingerprints)
