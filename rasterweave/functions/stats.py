"""Statistics of regions as column expressions; all are functions of (n, sum, sum of squares)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(n: Column, s: Column) -> Column:
    return F.when(n > 0, s / n).otherwise(F.lit(0.0))


def variance(n: Column, s: Column, s2: Column) -> Column:
    """Population variance, 0 at least."""
    m = s / n
    return F.when(n > 0, F.greatest(F.lit(0.0), s2 / n - m * m)).otherwise(F.lit(0.0))


def deviation(n: Column, s: Column, s2: Column) -> Column:
    return F.sqrt(variance(n, s, s2))


def _box(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    m = s / n
    return m, q / n - m * m


def fisher_signed(n: Column, s1: Column, s2: Column, q1: Column, q2: Column) -> Column:
    (m1, v1), (m2, v2) = _box(n, s1, q1), _box(n, s2, q2)
    return (m2 - m1) / F.sqrt(F.greatest(F.lit(1.0), v1 + v2))


def fisher_unsigned(n: Column, s1: Column, s2: Column, q1: Column, q2: Column) -> Column:
    (m1, v1), (m2, v2) = _box(n, s1, q1), _box(n, s2, q2)
    return (m2 - m1) * (m2 - m1) / F.greatest(F.lit(1.0), v1 + v2)


def value_range(m: Column, d: Column, alpha: float) -> tuple[Column, Column]:
    """The values a region may hold: mean -/+ max(alpha, alpha * deviation), in 0..255."""
    w = F.greatest(F.lit(float(alpha)), d * float(alpha))
    return F.greatest(F.lit(0.0), m - w), F.least(F.lit(255.0), m + w)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Shared part of ranges: lows between lo1 and hi1, highs between lo2 and hi2."""
    shared = F.when(hi1 > lo2, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), lo2 - hi1))
    return shared / F.greatest(F.lit(1.0), hi2 - lo1)
