"""Column expressions over arrays of doubles; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """v at length 1; a zero vector stays zero. The length is bound once, not found again for each component."""
    bound = F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n")))
    return F.transform(bound, lambda s: F.transform(s.v, lambda x: x / s.n))[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
