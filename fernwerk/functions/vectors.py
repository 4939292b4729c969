"""Vectors as ARRAY<DOUBLE> columns: distances, products and kernels as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def doubles(c: Column | str) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(ZERO), lambda a, x: a + x)


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rbf(a: Column, b: Column, sigma: float, beta: float = 1.0) -> Column:
    """beta * exp(-|a - b|^2 / sigma)."""
    return F.lit(float(beta)) * F.exp(-sqdist(a, b) / F.lit(float(sigma)))


def polynomial(a: Column, b: Column, degree: float, c: float = 1.0) -> Column:
    return F.pow(dot(a, b) + F.lit(float(c)), F.lit(float(degree)))


def known(x: Column) -> Column:
    """x, or null where it is not a number."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def affine(v: Column, shift: Sequence[float], factor: Sequence[float]) -> Column:
    """(v - shift) / factor, element by element."""
    moved = F.zip_with(v, lit_vector(shift), lambda x, s: x - s)
    return F.zip_with(moved, lit_vector(factor), lambda x, f: x / f)


def pick(v: Column, indices: Sequence[int]) -> Column:
    return F.array(*(v[int(k)] for k in indices))
