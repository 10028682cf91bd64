"""Vector functions on array columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def unit(x: Column, floor: float = 1e-8) -> Column:
    n = F.greatest(norm(x), F.lit(floor))
    return F.transform(x, lambda v: v / n)


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def softmax(x: Column) -> Column:
    level = log_sum_exp(x)
    return F.transform(x, lambda v: F.exp(v - level))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def upper_median(x: Column) -> Column:
    """The element in the middle of the ascending values, the upper one of two, at least 1."""
    return F.greatest(F.lit(1.0), F.get(F.sort_array(x), F.floor(F.size(x) / 2).cast("int")))
