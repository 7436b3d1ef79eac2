"""Vector scalars as Column expressions; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return clipped(F.try_divide(dot(a, b), norm(a) * norm(b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rounded(x: Column, digits: int = 6) -> Column:
    """As in SQL what is rounded to zero from below is minus zero; Spark alone drops the sign."""
    near = F.round(x, digits)
    return F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def finite(a: Column) -> Column:
    """Whether every component is a finite number."""
    return F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def nonzero(a: Column) -> Column:
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def repaired(a: Column) -> Column:
    """The vector, or zeros of its length where a component is not finite."""
    return F.when(finite(a), doubles(a)).otherwise(F.transform(a, lambda x: F.lit(0.0)))
