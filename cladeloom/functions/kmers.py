"""k-mer numbers of sequence windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmer_index(window: Column, k: int) -> Column:
    """Base-4 number of a k-letter window; any other letter gives 4**k."""
    clean = window.rlike(f"^[ACGT]{{{k}}}$")
    number = F.conv(F.translate(window, "ACGT", "0123"), 4, 10).cast("int")
    return F.when(clean, number).otherwise(F.lit(4**k))


def padded(seq: Column, k: int) -> Column:
    """The sequence with k//2 N letters on both sides."""
    pad = F.lit("N" * (k // 2))
    return F.concat(pad, F.upper(seq), pad)


def kmer_indices(seq: Column, k: int, sites: Column | None = None) -> Column:
    """array<int>: the k-mer number centred on every site, N beyond the ends."""
    whole = padded(seq, k)
    n = F.length(seq) if sites is None else F.least(F.length(seq), sites)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: kmer_index(F.substring(whole, i, F.lit(k)), k)
    )
