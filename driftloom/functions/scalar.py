"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(z: Column, a: Column | float) -> Column:
    """z less its part within [-a, a]."""
    a = a if isinstance(a, Column) else F.lit(float(a))
    return z - F.greatest(-a, F.least(a, z))


def huber(e: Column, a: float = 1.0) -> Column:
    """Half the square of e up to a, linear beyond."""
    return F.when(F.abs(e) <= a, e * e / 2).otherwise(a * (F.abs(e) - a / 2))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def or_nan(x: Column) -> Column:
    """NaN where a statistic does not exist."""
    return F.coalesce(x, F.lit(float("nan")))


def correlation(covariance: Column, a: Column, b: Column) -> Column:
    """Covariance over the product of standard deviations, NaN if one of them is 0."""
    return or_nan(F.try_divide(covariance, F.nullif(a * b, F.lit(0.0))))


def add_months_to(date: Column, n: Column | int) -> Column:
    return F.add_months(date, n)


def positive(v: Column) -> Column:
    """v > 0, false for NaN, which sorts above all numbers."""
    return (v > 0) & ~F.isnan(v)
