"""Numeric column builders, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def normal_pdf(x: Column, mean, sd) -> Column:
    m, s = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd))
    return F.exp(-0.5 * F.pow((x - m) / s, 2)) / (s * math.sqrt(2 * math.pi))


def softmax(array: Column) -> Column:
    """exp(x) / sum(exp(x)), shifted by the largest element."""
    e = F.transform(array, lambda x: F.exp(x - F.array_max(array)))
    return F.transform(e, lambda x: x / _sum(e))


def entropy(counts: Column) -> Column:
    """Of the distribution that counts stand for, in nats."""
    total = _sum(F.transform(counts, lambda x: x.cast("double")))
    return -_sum(F.transform(counts, lambda x: F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0)))


def bic(log_likelihood: Column, k: int, n: Column) -> Column:
    """Of a mixture of k components with three parameters each, and one weight more."""
    return -2 * log_likelihood + (3 * k + 1) * F.log(n)


def snap(x: Column, step: int, lo: int, hi: int) -> Column:
    """The nearest grid value; half way goes to the lower one."""
    return F.least(F.lit(hi).cast("long"), F.greatest(F.lit(lo).cast("long"), F.ceil(x / step - 0.5) * step))


def midpoint(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2)


def mixture_density(grid: Column, parts: Column, rest: Column, length: int) -> Column:
    """Density at each grid point: parts are structs (alpha, beta, w), rest the weight of the uniform part."""
    return F.transform(grid, lambda x: F.aggregate(parts, rest / length, lambda s, p: s + p["w"] * normal_pdf(x, p["alpha"], p["beta"])))


def finite(x: Column, bound: float) -> Column:
    return F.when(x == F.lit(float("inf")), bound).when(x == F.lit(float("-inf")), -bound).otherwise(x)
