"""Percentile definitions that differ in rounding and interpolation, over a sorted array; and interval formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(values: Column, index: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.least(F.greatest(index, F.lit(0)), n - 1) + 1).cast("int")))


#: The place in sorted order (from 0) that each definition takes, from the number of values and the share.
PLACES = {
    "truncating": lambda n, f: F.least(n - 1, F.floor(n * F.lit(f))),
    "half_even": lambda n, f: F.bround((n - 1) * F.lit(f)),
    "lower": lambda n, f: F.floor((n - 1) * F.lit(f)),
    "upper": lambda n, f: F.ceil((n - 1) * F.lit(f)),
    "upper_half": lambda n, f: F.floor(n / 2),
}


def between(low: Column, high: Column, n: Column, f: float) -> Column:
    """Linear interpolation over (n - 1) f between the values at the places ``lower`` and ``upper``."""
    exact = (n - 1) * F.lit(f)
    return low + (high - low) * (exact - F.floor(exact))


def truncating(values: Column, f: float) -> Column:
    """sorted[min(n - 1, int(f n))]"""
    return at(values, PLACES["truncating"](F.size(values), f))


def half_even(values: Column, p: float) -> Column:
    """sorted[round(p (n - 1))], ties to even."""
    return at(values, PLACES["half_even"](F.size(values), p))


def linear(c: Column, q: float) -> Column:
    """Linear interpolation over (n - 1) q; an aggregate over the column itself."""
    return F.percentile(c, F.lit(q))


def lower(values: Column, f: float) -> Column:
    """sorted[int((n - 1) f)]"""
    return at(values, PLACES["lower"](F.size(values), f))


def upper_half(values: Column) -> Column:
    """sorted[n // 2]"""
    return at(values, PLACES["upper_half"](F.size(values), 0.5))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) without observations."""
    p = successes / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (centre - half) / scale).otherwise(0.0), F.when(n > 0, (centre + half) / scale).otherwise(0.0)
