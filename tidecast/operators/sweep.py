"""Parameter sweeps: score parameter sets on past windows and keep the best.

A tuning window is a run whose training rows end the day before its target. The
score is the absolute error of the window's total.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import months_spanned
from tidecast.operators.analog import nearest_anchor
from tidecast.operators.forecast import forecast, horizon_requests
from tidecast.operators.structural import ModelSpec, fit_model
from tidecast.schemas import PARAM_NAMES, PARAM_TYPES
from tidecast.staging import days_of

MIN_TRAINING_ROWS = 100

# The grids, in product order (the last parameter varies fastest).
MONTHLY_GRID = {
    "recency_strength": [0.35, 1.0],
    "dow_shrinkage": [0.05, 0.25],
    "interaction_shrinkage": [0.20, 0.35],
    "seasonal_exponent": [1.0, 1.02],
    "trend_dampening": [0.7, 0.83],
    "forward_lift_daily": [0.0, 0.0025],
    "level_lookback_days": [60],
    "trend_seasonal_tilt": [0.0, 0.08],
}
WINDOW_GRID = {
    "recency_strength": [0.2, 0.35, 1.0],
    "dow_shrinkage": [0.05, 0.25, 0.1],
    "interaction_shrinkage": [0.20, 0.35, 0.5],
    "seasonal_exponent": [1.0, 1.02, 1.05],
    "trend_dampening": [0.7, 0.83, 0.9],
    "forward_lift_daily": [0.0, 0.0025, 0.005],
    "level_lookback_days": [30, 60, 90],
    "trend_seasonal_tilt": [0.0, 0.08, 0.15],
}
# The ranges of the continuous search.
SEARCH_RANGES = {
    "recency_strength": (0.0, 1.5),
    "dow_shrinkage": (0.0, 1.0),
    "interaction_shrinkage": (0.0, 1.0),
    "seasonal_exponent": (0.7, 1.3),
    "trend_dampening": (0.0, 1.0),
    "forward_lift_daily": (0.0, 0.02),
    "level_lookback_days": (20, 90),
    "trend_seasonal_tilt": (0.0, 1.0),
}
# Fixed value: applied on top of tuned parameters.
PRODUCTION_OVERRIDES = {"forward_lift_daily": 0.0}


def tuning_windows(series: DataFrame, start: Column, end: Column, train_start: dt.date) -> DataFrame:
    """Runs of past windows from rows of ``series`` (series_id and what the dates need)."""
    return series.select(
        F.concat_ws("@", "series_id", start.cast("string")).alias("run_id"),
        "series_id",
        F.lit(train_start).alias("train_start"),
        F.date_sub(start, 1).alias("train_end"),
        start.alias("target_start"),
        end.alias("target_end"),
    )


def monthly_windows(series: DataFrame, first: dt.date, last: dt.date,
                    train_start: dt.date) -> DataFrame:
    """One window per series and calendar month."""
    months = F.expr(
        f"sequence(trunc(date'{first}', 'MM'), trunc(date'{last}', 'MM'), interval 1 month)"
    )
    rows = series.select("series_id", F.explode(months).alias("m"))
    return tuning_windows(rows, F.col("m"), F.last_day("m"), train_start)


def mid_month_windows(series: DataFrame, start: dt.date, train_start: dt.date) -> DataFrame:
    """One window per series from a date to the same date of the next month."""
    s = F.lit(start)
    return tuning_windows(series, s, F.add_months(s, 1), train_start)


def expand_grid(runs: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Every run with every grid point; param_id is the point's place in the product."""
    rows = runs.select("run_id", F.lit(0).cast("long").alias("param_id"))
    for name in PARAM_NAMES:
        values = F.array(*[F.lit(v).cast(PARAM_TYPES[name]) for v in grid[name]])
        rows = rows.select(
            *[c for c in rows.columns], F.posexplode(values).alias("i", name)
        ).withColumn("param_id", F.col("param_id") * len(grid[name]) + F.col("i")).drop("i")
    return rows


def _space_filling_steps(d: int) -> list[float]:
    """Additive-recurrence steps: powers of the inverse root of x^(d+1) = x + 1."""
    x = 1.5
    for _ in range(200):
        x = math.pow(1.0 + x, 1.0 / (d + 1))
    return [round(math.pow(1.0 / x, j + 1), 12) for j in range(d)]


SEARCH_STEPS = dict(zip(PARAM_NAMES, _space_filling_steps(len(PARAM_NAMES))))


def search_point(name: str, trial: Column, seed: int) -> Column:
    """Value of one parameter in one trial: a low-discrepancy point of its range."""
    lo, hi = SEARCH_RANGES[name]
    u = F.lit(0.5) + (trial + seed).cast("double") * F.lit(SEARCH_STEPS[name])
    u = u - F.floor(u)
    if PARAM_TYPES[name] == "int":
        return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("int")
    return F.lit(lo) + u * (hi - lo)


def param_search_ranges(runs: DataFrame, n_trials: int, seed: int = 42) -> DataFrame:
    """``n_trials`` points of the ranges per run. Space-filling points replace a
    sequential sampler, so all trials of all windows run in one job."""
    trials = runs.select(
        "run_id", F.explode(F.sequence(F.lit(1), F.lit(n_trials))).alias("param_id")
    )
    return trials.select(
        "run_id",
        F.col("param_id").cast("long").alias("param_id"),
        *[search_point(p, F.col("param_id"), seed).alias(p) for p in PARAM_NAMES],
    )


def warm_start_params(windows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The nearest anchor's parameters as trial 0 of every window."""
    near = nearest_anchor(windows, anchors)
    return near.select(
        "run_id",
        F.lit(0).cast("long").alias("param_id"),
        *[F.col(p).cast(PARAM_TYPES[p]).alias(p) for p in PARAM_NAMES],
    )


def param_override(fits: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    values = PRODUCTION_OVERRIDES if overrides is None else overrides
    return fits.withColumns({p: F.lit(v).cast(PARAM_TYPES[p]) for p, v in values.items()})


def score_params(history: DataFrame, windows: DataFrame, fits: DataFrame, calendar: DataFrame,
                 spec: ModelSpec, months_forward: Column | int = 1) -> DataFrame:
    """Forecast and actual window total of every (window, parameter set), with its parameters."""
    fit = fit_model(history, windows, fits, calendar, spec)
    fit = replace(fit, model=fit.model.filter(F.col("n_train") >= MIN_TRAINING_ROWS))
    requests = horizon_requests(windows, months_forward, "target_start")
    span = windows.select("run_id", "series_id", "target_start", "target_end")
    actuals = (
        days_of(span, "target_start", "target_end")
        .join(history, ["series_id", "day"])
        .filter((F.weekday("day") < 5) & (F.col("amount") > 0))
        .select("run_id", "day", "amount")
    )
    totals = actuals.groupBy("run_id").agg(F.sum("amount").alias("actual_total"))
    fc = forecast(fit, requests, calendar)
    return (
        fc.join(actuals, ["run_id", "day"])
        .groupBy("run_id", "param_id")
        .agg(F.sum("forecast").alias("forecast_total"))
        .join(fit.fits.select("run_id", "param_id", *PARAM_NAMES), ["run_id", "param_id"])
        .join(totals, "run_id")
        .withColumn(
            "signed_pct_err",
            (F.col("forecast_total") - F.col("actual_total")) / F.col("actual_total") * 100,
        )
        .withColumn("abs_pct_err", F.abs("signed_pct_err"))
    )


SCORE_COLUMNS = ["param_id", "forecast_total", "actual_total", "signed_pct_err", "abs_pct_err"]


def argmin_params(scored: DataFrame) -> DataFrame:
    """Lowest error per window with its parameters; the first parameter set wins ties."""
    return (
        scored.filter(F.col("abs_pct_err").isNotNull())
        .groupBy("run_id")
        .agg(
            F.min_by(
                F.struct(*SCORE_COLUMNS, *PARAM_NAMES),
                F.struct(F.round("abs_pct_err", 9), F.col("param_id")),
            ).alias("b")
        )
        .select("run_id", "b.*")
    )


def param_sweep(history: DataFrame, windows: DataFrame, grid: dict[str, list[float]],
                calendar: DataFrame, spec: ModelSpec,
                months_forward: Column | int = 1) -> DataFrame:
    """Best grid point of every window."""
    fits = expand_grid(windows, grid)
    return argmin_params(score_params(history, windows, fits, calendar, spec, months_forward))


def search_params(history: DataFrame, windows: DataFrame, calendar: DataFrame, spec: ModelSpec,
                  n_trials: int, seed: int = 42, anchors: DataFrame | None = None) -> DataFrame:
    """Best point of the continuous search of every window."""
    fits = param_search_ranges(windows, n_trials, seed)
    if anchors is not None:
        fits = fits.unionByName(warm_start_params(windows, anchors))
    months = months_spanned(F.col("target_start"), F.col("target_end")) + 1
    return argmin_params(score_params(history, windows, fits, calendar, spec, months))


def value_counts(best: DataFrame, names: tuple[str, ...] = PARAM_NAMES, *keys: str) -> DataFrame:
    """How often each value of a parameter won."""
    return (
        best.unpivot(
            list(keys), [F.col(p).cast("double").alias(p) for p in names], "param", "value"
        )
        .groupBy(*keys, "param", "value")
        .agg(F.count("*").alias("n"))
    )


def anchors_from_sweep(best: DataFrame, windows: DataFrame, run_date: dt.date) -> DataFrame:
    """Tuned windows as rows of the anchor table."""
    rows = best.join(windows.drop("train_start", "train_end"), "run_id")
    january = (F.month("target_start") == 1) | (F.month("target_end") == 1)
    err = (F.col("abs_pct_err") / 100).cast("decimal(10,4)")
    return rows.select(
        F.concat_ws(" ", F.col("series_id"), F.date_format("target_start", "yyyy-MM-dd")).alias(
            "label"
        ),
        F.col("series_id").alias("channel"),
        F.col("target_start").alias("window_start"),
        F.col("target_end").alias("window_end"),
        F.add_months("target_start", -1).alias("prior_start"),
        F.date_sub("target_start", 1).alias("prior_end"),
        january.alias("january_only"),
        F.lit(False).alias("high_error_flag"),
        F.lit(run_date).alias("run_date"),
        err.alias("abs_err"),
        (F.col("signed_pct_err") / 100).cast("decimal(10,4)").alias("signed_err"),
        F.round("actual_total").cast("long").alias("actual_total"),
        F.round("forecast_total").cast("long").alias("forecast_total"),
        *PARAM_NAMES,
    )
