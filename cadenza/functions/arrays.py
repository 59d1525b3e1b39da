"""Measures between arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """Null of an empty array."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mean_squared_error(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def psnr(mse: Column, peak: float = 255.0, top: float = 100.0) -> Column:
    """Decibels; top where the error vanishes."""
    return F.when(mse < 1e-10, F.lit(top)).otherwise(10.0 * F.log10(F.lit(peak * peak) / mse))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
