"""Column expressions over counts, coverages and abundances."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(f: Column) -> Column:
    """1 above a share of 0.05, below it the logarithm that meets it there (P10)."""
    return F.when(f > 0.05, F.lit(1.0)).otherwise(F.log10(180 * f + 1))


def piecewise(cov: Column, category: Column, mean: Column, cutoff: float) -> Column:
    """Mean depth where coverage reaches the cutoff (half of it for small nodes), else 0."""
    return F.when(cov >= F.when(category.isin("1", "o1"), cutoff / 2).otherwise(F.lit(cutoff)), mean).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """A share as a percentage of two decimals (P12), rounded by the number's exact value as C's printf does: Java's rounds its shortest
    decimal form, half up, and so differs at ties."""

    @F.arrow_udf("string")
    def written(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.2f}%" for v in x.to_pylist()], pa.string())

    return written((100 * part / whole).cast("double"))


def without_singletons(cnt: Column) -> Column:
    """Counts of one, taken for errors, become 0."""
    return F.when(cnt <= 1, F.lit(0).cast("long")).otherwise(cnt)


def nearest(sorted_values: Column, q: float) -> Column:
    """Nearest-rank percentile of a sorted array: the element at q * (n - 1), rounded half to even."""
    return F.element_at(sorted_values, F.bround(F.lit(q) * (F.size(sorted_values) - 1)).cast("int") + 1)


def category(length: Column, leaf: Column, rebuilt: Column, weak: int = 1000, full: int = 3000, weak_leaves: bool = False) -> Column:
    """Node category by its number of k-mers (F17): 0 weak, 1 small, 2 full; o1 and o2 where the node was rebuilt.

    Leaves are never weak unless weak_leaves (F18, with 500 and 1500).
    """
    base = F.when(length < weak, F.lit("0") if weak_leaves else F.when(leaf, "1").otherwise("0")).when(length < full, "1").otherwise("2")
    return F.when(rebuilt & (base != "0"), F.concat(F.lit("o"), base)).otherwise(base)


def exist_evidence(abundance: Column, coverage: Column) -> Column:
    """F14."""
    return F.when((abundance > 0.02) & (coverage > 0.7), F.lit("*"))


def binomial_tail(n: Column, least: Column, p: float = 0.005) -> Column:
    """P(X >= least) for X ~ Bin(n, p), by the recurrence of the logarithms of its terms, which no n makes vanish (M2)."""
    ratio = math.log(p / (1 - p))
    step = F.aggregate(
        F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))),
        F.struct((n * math.log1p(-p)).cast("double").alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] + F.log(F.greatest(n - i, F.lit(0)) / (i + 1)) + ratio).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
    )
    return F.when(least <= 0, F.lit(1.0)).when(least > n, F.lit(0.0)).otherwise(F.greatest(1 - step["s"], F.lit(0.0)))


def keep_both(x: Column, y: Column) -> Column:
    """Are two siblings' abundances both too large for one to be noise of the other (M2)?"""
    return binomial_tail((x + y).cast("long"), F.least(x, y).cast("long")) < 0.05
