"""Regimes from the latest monthly indicators, and the parameters they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import business_day_add
from tidecast.operators.indicators import indicators_by_day
from tidecast.schemas import PARAM_NAMES, PARAM_TYPES
from tidecast.staging import carried_days

REGIME_IDS = {"January": 0, "Regime1": 1, "Regime2": 2}
# Model A parameters per regime, in the order of PARAM_NAMES.
REGIME_PARAMS = {
    "January": (0.20, 0.25, 0.35, 1.05, 0.70, 0.0025, 60, 0.04),
    "Regime1": (1.0, 0.10, 0.20, 1.05, 0.70, 0.005, 90, 0.15),
    "Regime2": (0.68, 0.15, 0.28, 1.02, 0.83, 0.0, 60, 0.04),
}
# Fixed values: (mean, std, weight) of the indicators of the weighted composite.
WEIGHTED_INDICATORS = {
    "application_count_per_bizday_growth_1m": (0.00, 0.08, 0.45),
    "application_count_per_bizday_growth_3m": (0.00, 0.12, 0.35),
    "approval_events_per_bizday_growth_1m": (-0.016, 0.107, 0.20),
}
WEIGHTED_THRESHOLD = 0.25
# Fixed values: (mean, std) of the indicators of the equal-weight composite.
EQUAL_INDICATORS = {
    "application_count_per_bizday": (175.93, 14.89),
    "approval_events_per_bizday_growth_1m": (-0.016, 0.107),
    "underwriting_submission_events_per_bizday_growth_1m": (-0.018, 0.099),
}
EQUAL_THRESHOLD = 0.30


def regime_params(spark: SparkSession) -> DataFrame:
    rows = [(n, REGIME_IDS[n], *v) for n, v in REGIME_PARAMS.items()]
    cols = ", ".join(f"{p} {PARAM_TYPES[p]}" for p in PARAM_NAMES)
    return spark.createDataFrame(rows, f"regime string, param_id long, {cols}")


def weighted_composite() -> Column:
    """Weighted sum of z-scores; a missing indicator scores 0."""
    out = F.lit(0.0)
    for name, (mean, std, weight) in WEIGHTED_INDICATORS.items():
        out = out + weight * F.coalesce((F.col(name) - mean) / std, F.lit(0.0))
    return out


def equal_composite() -> Column:
    """Mean of three z-scores; a missing indicator makes it null."""
    out = F.lit(0.0)
    for name, (mean, std) in EQUAL_INDICATORS.items():
        out = out + (F.col(name) - mean) / std
    return out / 3.0


def regime_label(month: Column, composite: Column, threshold: float) -> Column:
    return (
        F.when(month == 1, F.lit("January"))
        .when(composite >= threshold, F.lit("Regime2"))
        .otherwise(F.lit("Regime1"))
    )


def run_indicators(funnel: DataFrame, runs: DataFrame, smooth: bool = True) -> DataFrame:
    """Latest month-to-date indicators of every run, from the rows before its ``today``.

    The indicators are computed once per series and file date, and a run looks its day up: the
    work does not grow with runs times history, and no join is by the series alone.
    """
    seen = runs.select("run_id", "series_id", business_day_add(F.col("today"), -1).alias("as_of"))
    until = seen.agg(F.max("as_of")).first()[0]
    days = carried_days(indicators_by_day(funnel, smooth), "filedt", F.lit(until).cast("date"))
    return seen.join(days.drop("filedt"), ["series_id", "as_of"]).drop("series_id", "as_of")
