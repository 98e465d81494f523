"""Exact products, tie tolerance and hash-based uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = "decimal(38,0)"
# Absolute and relative slack within which two real weights tie.
TIE_ABS = 1e-10
TIE_REL = 1e-10


def ties_with_best(value: Column, best: Column) -> Column:
    slack = TIE_ABS + TIE_REL * F.greatest(F.lit(1.0), F.abs(best))
    return value <= best + slack


def fold_factors(factors: Column) -> Column:
    """Exact product of ``array<struct<f,m>>`` (factor, multiplicity).

    NULL when the product does not fit DECIMAL(38,0).  At most 126 factors of
    two fit, so longer lists are refused before any multiplication.
    """
    one = F.lit(1).cast(COUNT)
    total = F.aggregate(factors, F.lit(0).cast("bigint"), lambda a, x: a + x["m"])
    repeated = F.aggregate(
        factors,
        one,
        lambda acc, x: F.aggregate(
            F.sequence(F.lit(1), x["m"].cast("int")),
            acc,
            lambda b, _: F.try_multiply(b, x["f"]).cast(COUNT),
        ),
    )
    return F.when(total == 0, one).when(total <= 126, repeated)


def uniform_draw(*parts) -> Column:
    """A reproducible number in (0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    as_int = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return (as_int + 0.5) / F.lit(float(16**12))
