"""Order-free keys for sets of leaves.

A leaf set is keyed by its size plus two 64-bit XOR lanes of member hashes.  XOR
is associative and commutative, so the key is an ordinary partial aggregate: a
set of a billion leaves costs three longs per map task and is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lane seeds of the set key.
LANES = (104729, 1299709)


def member_lanes(*cols) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *cols) for seed in LANES]


def set_key(*cols) -> Column:
    """Aggregate: key of the set of (distinct) rows in the group."""
    a, b = member_lanes(*cols)
    return F.struct(
        F.count(F.lit(1)).alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b")
    )


def union_keys(key: Column) -> Column:
    """Aggregate: key of the union of disjoint sets, from their keys."""
    return F.struct(
        F.sum(key["n"]).alias("n"),
        F.bit_xor(key["a"]).alias("a"),
        F.bit_xor(key["b"]).alias("b"),
    )


def singleton_key(*cols) -> Column:
    a, b = member_lanes(*cols)
    return F.struct(F.lit(1).cast("bigint").alias("n"), a.alias("a"), b.alias("b"))


def key_text(key: Column) -> Column:
    return F.concat_ws("-", key["n"].cast("string"), F.hex(key["a"]), F.hex(key["b"]))
