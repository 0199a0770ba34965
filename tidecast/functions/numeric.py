"""Null-safe arithmetic. ANSI mode is on, so every division guards its base."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b as double, null for a zero or null base."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b for a positive base, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def safe_pct(current: Column, prior: Column) -> Column:
    """Relative change against a positive base, else 0."""
    return safe_ratio(current - prior, prior)


def pct_change(current: Column, previous: Column) -> Column:
    """current / previous - 1, null for a zero or missing base."""
    return F.try_divide(current, previous) - 1


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = F.lit(lo) if isinstance(lo, (int, float)) else lo
    hi = F.lit(hi) if isinstance(hi, (int, float)) else hi
    return F.greatest(lo, F.least(hi, x))


def null_fill(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def numeric_coerce(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Cast all columns but ``keep`` to double; text that is no number becomes null."""
    keep = set(keep)
    return df.select(
        *[F.col(c) if c in keep else F.col(c).try_cast("double").alias(c) for c in df.columns]
    )
