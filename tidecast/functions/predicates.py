"""Row predicates and label rules on business columns (matching ignores case)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status codes that take a loan out of the funnel.
EXCLUDED_STATUS_CODES = (
    "0110", "0115", "0120", "0125", "0130", "0140", "0150", "0160", "0170",
    "0180", "0182", "0189", "0190", "0191", "0192", "0360", "0362", "0370",
    "0375", "0510", "0610", "0618", "0710", "0711", "0715", "0720", "1040",
)
# Channel patterns.
CORRESPONDENT_PATTERN = "%corr%"
CORRESPONDENT_NAME = "Correspondent"
EXCLUDED_CHANNEL_PATTERN = "%Credit Union Partners%"


def normalized_channel(channel: Column) -> Column:
    return F.when(channel.ilike(CORRESPONDENT_PATTERN), F.lit(CORRESPONDENT_NAME)).otherwise(channel)


def channel_kept(channel: Column, pattern: str = EXCLUDED_CHANNEL_PATTERN) -> Column:
    """False or null (so dropped by a filter) for excluded and null channels."""
    return ~channel.ilike(pattern)


def status_kept(status: Column) -> Column:
    """Status without a letter C and outside the excluded codes; null drops."""
    return ~status.ilike("%c%") & ~status.isin(*EXCLUDED_STATUS_CODES)


def trailing_years(d: Column, today: Column, years: int) -> Column:
    return d >= F.add_months(today, -12 * years)


def source_label(d: Column, known_through: Column) -> Column:
    return F.when(d <= known_through, F.lit("actual")).otherwise(F.lit("forecast"))


def weekend_zero(df: DataFrame, day: str, cols: list[str]) -> DataFrame:
    weekend = F.weekday(F.col(day)) >= 5
    return df.withColumns(
        {c: F.when(weekend, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols}
    )


def known_override(df: DataFrame, day: str, known_through: str) -> DataFrame:
    """Inside the known window the forecast is the actual."""
    known = F.col(day) <= F.col(known_through)
    return df.withColumns(
        {
            "forecast": F.when(known, F.col("actual")).otherwise(F.col("forecast")),
            "model_used": F.when(known, F.lit("actual")).otherwise(F.col("model_used")),
        }
    )
