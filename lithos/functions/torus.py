"""Arithmetic on a torus, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(x: Column, size: float) -> Column:
    """Into 0 <= x < size."""
    return F.pmod(x, F.lit(float(size)))


def shortest(a: Column, b: Column, size: float) -> Column:
    """Signed shortest way from ``a`` to ``b``."""
    d = b - a
    return F.when(d > size / 2, d - size).when(d < -size / 2, d + size).otherwise(d)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
