"""Batch backtest: many past date ranges through the analog forecast in one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import business_day_add, months_spanned
from tidecast.operators.evaluate import within_bands
from tidecast.plans.analog_forecast import AnalogIndex, analog_forecast, match_label
from tidecast.staging import days_of

# The date ranges, as first and last day.
DATE_RANGES = (
    ("2025-10-01", "2025-10-31"), ("2025-10-10", "2025-11-10"), ("2025-10-20", "2025-11-20"),
    ("2025-10-30", "2025-11-30"), ("2025-11-01", "2025-11-30"), ("2025-11-10", "2025-12-10"),
    ("2025-11-20", "2025-12-20"), ("2025-11-30", "2025-12-30"), ("2025-12-01", "2025-12-31"),
    ("2025-12-10", "2026-01-10"), ("2025-12-20", "2026-01-20"), ("2025-12-30", "2026-01-30"),
    ("2026-01-01", "2026-01-31"), ("2026-01-10", "2026-02-10"), ("2026-01-20", "2026-02-20"),
    ("2026-01-30", "2026-02-28"), ("2026-02-01", "2026-02-28"), ("2026-02-10", "2026-03-10"),
    ("2026-02-20", "2026-03-20"), ("2026-03-01", "2026-03-31"), ("2026-03-10", "2026-04-10"),
    ("2026-03-20", "2026-04-20"), ("2026-03-30", "2026-04-30"),
)


def backtest_runs(series: DataFrame, train_start: dt.date, month_shift: int = 0,
                  ranges: tuple[tuple[str, str], ...] = DATE_RANGES) -> DataFrame:
    """One run per series and date range; the range's first day plays today."""
    spans = F.array(
        *[F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
          for a, b in ranges]
    )
    rows = series.select("series_id", F.explode(spans).alias("s")).select(
        "series_id",
        F.add_months("s.a", month_shift).alias("range_start"),
        F.add_months("s.b", month_shift).alias("range_end"),
    )
    known = business_day_add(F.col("range_start"), 3)
    return rows.select(
        F.concat_ws("@", "series_id", F.col("range_start").cast("string"),
                    F.col("range_end").cast("string")).alias("run_id"),
        "series_id",
        "range_start",
        "range_end",
        F.col("range_start").alias("today"),
        F.lit(train_start).alias("train_start"),
        known.alias("known_through"),
        business_day_add(F.col("range_start"), 4).alias("forecast_start"),
        F.col("range_end").alias("forecast_end"),
        F.least(known, F.col("range_end")).alias("actuals_through"),
    )


def batch_backtest(history: DataFrame, index: AnalogIndex, runs: DataFrame, calendar: DataFrame,
                   train_start: dt.date, k: int = 3, min_gap_days: int = 21, n_trials: int = 50,
                   seed: int = 42, anchors: DataFrame | None = None) -> DataFrame:
    """Known actuals plus forecast against the actual total of every range."""
    spanned = months_spanned(F.col("forecast_start"), F.col("range_end"))
    result = analog_forecast(
        history, index, runs, calendar, train_start, k, min_gap_days, n_trials, seed, anchors,
        months_forward=F.greatest(spanned, F.lit(0)) + 1,
    )
    dates = runs.select("run_id", "range_end", "actuals_through")
    # holidays and weekends are zero in a forecast, so they add nothing to the total
    ahead = (
        result.blended.join(dates, "run_id")
        .filter((F.col("day") > F.col("actuals_through")) & (F.col("day") <= F.col("range_end")))
        .groupBy("run_id")
        .agg(F.sum("forecast").alias("forecast_sum"))
    )
    span = runs.select("run_id", "series_id", "range_start", "range_end", "actuals_through")
    actuals = (
        days_of(span, "range_start", "range_end")
        .join(history, ["series_id", "day"])
        .filter(F.weekday("day") < 5)
        .groupBy("run_id")
        .agg(
            F.sum("amount").alias("actuals_total"),
            F.sum(F.when(F.col("day") <= F.col("actuals_through"), F.col("amount"))).alias(
                "known_total"
            ),
        )
    )
    tuned = result.matches.groupBy("run_id").agg(
        F.avg("tune_abs_err").alias("mean_tune_err"), F.max("n_failed").alias("n_failed")
    )
    ok = F.coalesce(F.col("n_failed") == 0, F.lit(False))
    rows = (
        runs.join(tuned, "run_id", "left")
        .join(match_label(result.matches), "run_id", "left")
        .join(ahead, "run_id", "left")
        .join(actuals, "run_id", "left")
        .withColumn(
            "error",
            F.when(F.col("n_failed").isNull(), "no analog matches found")
            .when(~ok, "a matched window has too little history or no actuals")
            .otherwise(""),
        )
        .withColumn("forecast_total", F.when(ok, F.coalesce("forecast_sum", F.lit(0.0))))
        .withColumn(
            "blended_total",
            F.coalesce("known_total", F.lit(0.0)) + F.coalesce("forecast_total", F.lit(0.0)),
        )
        .withColumn("difference", F.col("blended_total") - F.col("actuals_total"))
    )
    return rows.select(
        "run_id",
        "series_id",
        "range_start",
        "range_end",
        "today",
        "actuals_through",
        F.date_add("actuals_through", 1).alias("forecast_from"),
        F.when(ok, F.col("analogs_used")).otherwise("").alias("analogs_used"),
        F.when(ok, F.col("mean_tune_err")).alias("mean_tune_err"),
        "actuals_total",
        "forecast_total",
        "blended_total",
        "difference",
        F.when(ok & (F.col("actuals_total") > 0),
               F.col("difference") / F.col("actuals_total") * 100).alias("pct_difference"),
        "error",
    )


def backtest_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Mean, median, maximum error, bands and mean tuning error of the good ranges."""
    return within_bands(
        results.filter(F.col("pct_difference").isNotNull()),
        "pct_difference",
        *keys,
        extra=[F.avg("mean_tune_err").alias("mean_tune_err")],
    )
