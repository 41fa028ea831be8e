"""Date, number and map functions as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_ordinal(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def mid_quarter(date: Column) -> Column:
    return F.make_date(F.year(date), (F.quarter(date) - 1) * 3 + 2, F.lit(15))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinite over 0, null for 0 over 0."""
    return F.when(b != 0, a / b).when(a != 0, F.lit(math.inf))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bucket(x: Column, t: float) -> Column:
    return F.when(x <= -t, "critical").when(x >= t, "supportive").when(x.isNotNull(), "neutral")


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the values that are not null, weights renormalised; null if all are."""
    total = sum((F.coalesce(v, F.lit(0.0)) * weights[k] for k, v in values.items()), F.lit(0.0))
    present = sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    return F.when(present > 0, total / present)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval for a proportion, within 0 and 1; null for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))
