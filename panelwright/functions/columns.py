"""Column expressions that the built-in functions don't have by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from panelwright.config import BPS


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is not positive or missing; a missing num stays missing."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def bps(c: Column) -> Column:
    return c * F.lit(BPS)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def average_rank_pct(c: Column, instant: WindowSpec) -> Column:
    """Average rank over the non-null values of the window's partition, as a share of their number."""
    ordered = instant.orderBy(c.asc_nulls_last())
    up_to = ordered.rangeBetween(-(1 << 63), 0)
    n = F.count(c).over(instant)
    return F.when(c.isNotNull(), (F.rank().over(ordered) + F.count(c).over(up_to)) / 2.0 / n)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected, null under 3 values."""
    n, g = F.count(c), F.skewness(c)
    return F.when(n > 2, F.sqrt((n * (n - 1)).cast("double")) / F.greatest(n - 2, F.lit(1)) * g)


def sample_excess_kurtosis(c: Column) -> Column:
    """Bias-corrected, null under 4 values."""
    n, g = F.count(c).cast("double"), F.kurtosis(c)
    return F.when(n > 3, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g + 6))


def float32_error(c: Column) -> Column:
    """Absolute error of a round trip through float32."""
    return F.abs(c - c.cast("float").cast("double"))


def float32_relative_error(c: Column) -> Column:
    return F.when(c != 0, float32_error(c) / F.abs(c)).otherwise(F.lit(0.0))
