"""Exact products of any size, as decimal text."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tree_product(values: list[int]) -> int:
    """Product by halves, so that large numbers meet numbers of their own size."""
    while len(values) > 1:
        values = [prod(values[i : i + 2]) for i in range(0, len(values), 2)]
    return values[0] if values else 1


def exact_products(df: DataFrame, by: str, factor: str) -> DataFrame:
    """(by, product): the product of ``factor`` over the rows of each group.

    Equal factors are counted first; each task multiplies its own part of every
    group, and only the tasks' partial products meet.  A null factor raises.
    """
    kind = df.schema[by].dataType.simpleString()
    known = F.coalesce(F.col(factor).cast("string"), F.raise_error(F.lit("a factor is missing")).cast("string"))
    counted = df.select(by, known.alias("factor")).groupBy(by, "factor").agg(F.count(F.lit(1)).alias("times"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, f, n in zip(batch[by], batch["factor"], batch["times"]):
                held[key] = held.get(key, 1) * int(f) ** int(n)
        yield pd.DataFrame({by: list(held), "part": [f"{v:x}" for v in held.values()]})

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        product = _tree_product([int(x, 16) for x in parts["part"]])
        return pd.DataFrame({by: [parts[by].iloc[0]], "product": [_decimal(product)]})

    return counted.mapInPandas(partial, f"{by} {kind}, part string").groupBy(by).applyInPandas(whole, f"{by} {kind}, product string")


def _decimal(n: int) -> str:
    """Decimal digits of a number of any size, by halves."""
    if n < 10**4000:
        return str(n)
    half = max(1, n.bit_length() // 7)  # about half of its decimal digits
    high, low = divmod(n, 10**half)
    return _decimal(high) + _decimal(low).rjust(half, "0")
