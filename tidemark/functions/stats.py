"""Numeric expressions with the same results in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, by floor, so that no engine's own rounding of doubles matters."""
    k = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * k + 0.5) / k


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else NULL."""
    return F.when(b > 0, a / b)


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Weights of NULL parts are shared out among the others."""
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for w, x in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0)) / total)


def median_of(a: Column) -> Column:
    """Median of an array, the mean of the middle two where their number is even."""
    s, n = F.array_sort(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
