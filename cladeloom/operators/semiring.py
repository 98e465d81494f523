"""Weight algebras for the DAG dynamic programs.

A semiring says what a leaf weighs, how an edge changes the weight of the node
below it, how the alternatives of one clade combine and how the clades of one
node combine.  ``within`` and ``between`` map a table of weights to one grouped
by ``by``; all are mergeable aggregates, so a clade holding a third of all edges
is reduced map-side before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.functions.numbers import COUNT, fold_factors
from cladeloom.runtime import cut


def mutation_cost() -> Column:
    return F.size("mutations").cast("bigint")


def stored_weight() -> Column:
    return F.col("edge_weight").cast("double")


def mutation_cost_off_root() -> Column:
    """Mutation count with edges out of the pseudo-root free."""
    return F.when(F.col("parent_is_ua"), F.lit(0)).otherwise(F.size("mutations")).cast("bigint")


class Semiring:
    values: tuple[str, ...] = ("w",)
    additive = False

    def edge(self) -> dict[str, Column]:
        """Extra edge columns the algebra needs."""
        return {}

    def leaf(self) -> dict[str, Column]:
        raise NotImplementedError

    def lift(self, df: DataFrame) -> DataFrame:
        return df

    def within(self, df: DataFrame, by: list[str]) -> DataFrame:
        raise NotImplementedError

    def between(self, df: DataFrame, by: list[str]) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class BestWeight(Semiring):
    """Additive weights, best alternative per clade: min (default) or max."""

    weight: Column = field(default_factory=mutation_cost)
    largest: bool = False
    dtype: str = "bigint"
    tolerant: bool = False
    values = ("w",)
    additive = True

    def edge(self):
        return {"edge_w": self.weight.cast(self.dtype)}

    def leaf(self):
        return {"w": F.lit(0).cast(self.dtype)}

    def lift(self, df):
        return df.withColumn("w", (F.col("w") + F.col("edge_w")).cast(self.dtype))

    def within(self, df, by):
        best = F.max("w") if self.largest else F.min("w")
        return df.groupBy(*by).agg(best.alias("w"))

    def between(self, df, by):
        return df.groupBy(*by).agg(F.sum("w").cast(self.dtype).alias("w"))


def _product(df: DataFrame, by: list[str], carry: dict[str, Column]) -> DataFrame:
    """Exact product of ``n`` per group: equal factors merge before the shuffle."""
    runs = df.groupBy(*by, "n").agg(
        F.count(F.lit(1)).alias("m"), *[c.alias(k) for k, c in carry.items()]
    )
    factor = F.when(F.col("n") != 1, F.struct(F.col("n").alias("f"), F.col("m")))
    return (
        runs.groupBy(*by)
        .agg(
            F.collect_list(factor).alias("factors"),
            F.max(F.col("n").isNull()).alias("lost"),
            *[F.sum(k).alias(k) for k in carry],
        )
        .withColumn("n", F.when(~F.col("lost"), fold_factors(F.col("factors"))))
        .drop("lost")
    )


@dataclass(frozen=True)
class TreeCount(Semiring):
    """Number of trees below a node, exact in DECIMAL(38,0), NULL beyond it.

    ``factors`` keeps the clade counts other than one (their number is at most
    the bit length of the product) so that the upward count can leave one out.
    """

    values = ("n", "factors")

    def leaf(self):
        none = F.array().cast(f"array<struct<f:{COUNT},m:bigint>>")
        return {"n": F.lit(1).cast(COUNT), "factors": none}

    def within(self, df, by):
        return df.groupBy(*by).agg(F.try_sum("n").cast(COUNT).alias("n"),
                                   F.max(F.col("n").isNull()).alias("lost")).withColumn(
            "n", F.when(~F.col("lost"), F.col("n"))).drop("lost")

    def between(self, df, by):
        return _product(df, by, {})


@dataclass(frozen=True)
class TreeLogCount(Semiring):
    """Natural logarithm of the number of trees below a node, of any size.

    Alternatives add up relative to the largest one: a window over the clade
    finds it, and the sum needs no further exchange.
    """

    values = ("log_n",)

    def leaf(self):
        return {"log_n": F.lit(0.0)}

    def within(self, df, by):
        top = F.max("log_n").over(Window.partitionBy(*by)).alias("top")
        return (
            df.groupBy(*by, "log_n").agg(F.count(F.lit(1)).alias("same")).select("*", top)
            .groupBy(*by)
            .agg((F.max("top") + F.log(F.sum(F.col("same") * F.exp(F.col("log_n") - F.col("top"))))).alias("log_n"))
        )

    def between(self, df, by):
        return df.groupBy(*by).agg(F.sum("log_n").alias("log_n"))


@dataclass(frozen=True)
class BestCount(Semiring):
    """Best weight together with the number of trees that attain it."""

    weight: Column = field(default_factory=mutation_cost)
    largest: bool = False
    values = ("w", "n")

    def edge(self):
        return {"edge_w": self.weight}

    def leaf(self):
        return {"w": F.lit(0).cast("bigint"), "n": F.lit(1).cast(COUNT)}

    def lift(self, df):
        return df.withColumn("w", F.col("w") + F.col("edge_w"))

    def within(self, df, by):
        level = df.groupBy(*by, "w").agg(
            F.try_sum("n").cast(COUNT).alias("n"), F.max(F.col("n").isNull()).alias("lost")
        )
        # plain values, not a struct of them: such aggregates hash, those of structs sort
        n = F.when(~F.col("lost"), F.col("n"))
        if self.largest:
            return level.groupBy(*by).agg(F.max("w").alias("w"), F.max_by(n, F.col("w")).alias("n"))
        return level.groupBy(*by).agg(F.min("w").alias("w"), F.min_by(n, F.col("w")).alias("n"))

    def between(self, df, by):
        return _product(df, by, {"w": F.sum("w")}).drop("factors")


@dataclass(frozen=True)
class Histogram(Semiring):
    """Number of trees per weight: rows (w, n); clades combine by convolution.

    ``count_type`` may be bigint where counts stay small; a count that does not
    fit raises.  ``clades`` is the number of clades where it is known; without it
    every level is written and its rounds follow from the data.
    """

    weight: Column = field(default_factory=mutation_cost)
    clades: int | None = None
    count_type: str = COUNT
    values = ("w", "n")

    def edge(self):
        return {"edge_w": self.weight}

    def leaf(self):
        return {"w": F.lit(0).cast("bigint"), "n": F.lit(1).cast(self.count_type)}

    def lift(self, df):
        return df.withColumn("w", F.col("w") + F.col("edge_w"))

    def within(self, df, by):
        return df.groupBy(*by, "w").agg(_fits(F.try_sum("n"), self.count_type).alias("n"))

    def between(self, df, by):
        return convolve(df, by, "clade_index", self.clades, self.count_type)


@dataclass(frozen=True)
class SubtreeSize(Semiring):
    """Leaves, nodes and height below each node of a tree."""

    values = ("leaves", "nodes", "depth")

    def leaf(self):
        return {"leaves": F.lit(1).cast("bigint"), "nodes": F.lit(1).cast("bigint"), "depth": F.lit(0)}

    def within(self, df, by):
        return df.groupBy(*by).agg(
            F.sum("leaves").alias("leaves"), F.sum("nodes").alias("nodes"), F.max("depth").alias("depth")
        )

    def between(self, df, by):
        return df.groupBy(*by).agg(
            F.sum("leaves").alias("leaves"), (F.sum("nodes") + 1).alias("nodes"),
            (F.max("depth") + 1).alias("depth"),
        )


def _fits(value: Column, count_type: str) -> Column:
    """The value, or an error where a ``try_`` operation overflowed."""
    return F.coalesce(value.cast(count_type), F.raise_error(F.lit("tree count does not fit")).cast(count_type))


def convolve(df: DataFrame, by: list[str], index: str, width: int | None = None, count_type: str = COUNT) -> DataFrame:
    """Distribution of the sum over ``index`` of independent histograms.

    Neighbours 2i and 2i+1 combine each round, so k clades take log2(k) rounds
    and a sparse index costs nothing: an unpaired clade passes through.  A round
    gathers the two histograms of a pair and multiplies them out, one exchange
    each, so the plan below is read once.  Without ``width`` the rounds follow
    from the largest index of the written table; an index beyond a given width
    raises.
    """
    if width is None:
        df = cut(df, "histograms")
        width = (df.agg(F.max(index)).first()[0] or 0) + 1
    one = F.lit(1).cast(count_type)
    while width > 1:
        side = F.col(index) % 2
        held = F.struct("w", "n")
        pairs = df.groupBy(*by, F.floor(F.col(index) / 2).cast("int").alias("slot")).agg(
            F.collect_list(F.when(side == 0, held)).alias("a"), F.collect_list(F.when(side == 1, held)).alias("b")
        )
        met = pairs.select(*by, "slot", F.explode_outer("a").alias("a"), "b").select(
            *by, "slot", "a", F.explode_outer("b").alias("b")
        )
        n = _fits(F.try_multiply(F.coalesce("a.n", one), F.coalesce("b.n", one)), count_type)
        w = F.coalesce("a.w", F.lit(0)) + F.coalesce("b.w", F.lit(0))
        df = met.groupBy(*by, F.col("slot").alias(index), w.alias("w")).agg(_fits(F.try_sum(n), count_type).alias("n"))
        width = (width + 1) // 2
    left_over = F.raise_error(F.lit("a clade index lies beyond the given number of clades")).cast("bigint")
    return df.select(*by, F.when(F.col(index) == 0, F.col("w")).otherwise(left_over).alias("w"), "n")


# Histogram algebra on (key..., w, n) tables.
def histogram_union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "w").agg(F.sum("n").cast(COUNT).alias("n"))


def histogram_product(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """All sums of one weight from each side; an empty side gives the other's identity."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return convolve(both, by, "side", 2)
