"""Small numeric expressions.  NULL means missing everywhere; NaN is never produced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode would raise)."""
    return a / F.nullif(b, F.lit(0.0))


def div_or(a: Column, b: Column, default: Column) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(default)


def zero_to(x: Column, value: float) -> Column:
    return F.when(x == 0, F.lit(float(value))).otherwise(x)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep NULL (greatest/least alone would replace it by the bound)."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def flag(cond: Column) -> Column:
    """A comparison against a missing value is false, not NULL."""
    return F.coalesce(cond, F.lit(False))


def pct_change(x: Column, prev: Column) -> Column:
    return div(x - prev, prev)


def no_nan(x: Column) -> Column:
    """NaN and infinities to NULL; apply on ingestion because Spark orders NaN above every number and no infinite price is one."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def half_up(x: Column, digits: int) -> Column:
    """floor(x*10^d + 0.5) / 10^d: rounds the same way in every engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def weighted_sum(parts: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for x, w in parts:
        out = out + x * F.lit(float(w))
    return out
