"""Column functions over array columns: medians, differences, even picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(a: Column) -> Column:
    """Median of the non-null elements; null if there are none. The elements are sorted once."""

    def middle(s):
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return F.get(F.transform(F.array(F.sort_array(F.filter(a, lambda x: x.isNotNull()))), middle), F.lit(0))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the product's and the sum's own errors are added back."""
    p = a * b
    upper = lambda x: x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    ah, bh = upper(a), upper(b)
    al, bl = a - ah, b - bh
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    return s + ((p - (s - (s - p))) + (c - (s - p)) + lost)


def quantile(a: Column, q: float) -> Column:
    """Interpolated quantile of an array without nulls, null if empty; rounded as DuckDB's quantile_cont, where the last product and sum are fused."""
    place = (F.size(a) - 1) * F.lit(q)
    d = place - F.floor(place)

    def between(s):
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return F.when(low == high, low).otherwise(fused(low, F.lit(1.0) - d, high * d))

    return F.get(F.transform(F.array(F.sort_array(a)), between), F.lit(0))


def differences(a: Column) -> Column:
    """Each element minus the one before."""
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def mad_sigma(a: Column) -> Column:
    """Median absolute deviation / 0.67449; null for an empty array."""
    m = median(a)
    return median(F.transform(a, lambda x: F.abs(x - m))) / F.lit(0.67449)


def median_cadence_days(dates: Column) -> Column:
    """Median gap between consecutive dates of an array, in days."""
    gaps = F.zip_with(F.slice(dates, F.lit(2), F.greatest(F.size(dates) - 1, F.lit(0))), F.slice(dates, F.lit(1), F.greatest(F.size(dates) - 1, F.lit(0))), lambda x, y: F.datediff(x, y))
    return median(gaps)


def even_picks(n: Column, k: int) -> Column:
    """k places spread evenly over 0..n-1, ends included, halves to even, without repeats."""
    if k == 1:
        return F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(k - 1), 0).cast("int"))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.when(n <= k, every).otherwise(F.array_distinct(spots))
