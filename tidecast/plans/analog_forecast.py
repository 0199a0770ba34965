"""Analog forecast: match, tune each match, fit on live data, blend."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import months_spanned
from tidecast.operators.analog import (
    analog_distance,
    analog_queries,
    analog_topk_min_gap,
    candidate_window_index,
    robust_norm_stats,
    two_window_signature,
)
from tidecast.operators.forecast import forecast, horizon_requests
from tidecast.operators.structural import MODEL_R, fit_model
from tidecast.operators.sweep import param_override, search_params
from tidecast.schemas import PARAM_NAMES
from tidecast.staging import stage

WEIGHT_EPSILON = 1e-3


@dataclass(frozen=True)
class AnalogIndex:
    """Staged signatures of all origins with the candidates and scales drawn from them."""

    signatures: DataFrame
    candidates: DataFrame
    norm: DataFrame


def build_index(funnel: DataFrame, history: DataFrame, until: dt.date) -> AnalogIndex:
    signatures = stage(two_window_signature(funnel, until), "signatures")
    candidates = stage(candidate_window_index(signatures, funnel, history), "candidates")
    return AnalogIndex(signatures, candidates, robust_norm_stats(candidates))


def find_analogs(index: AnalogIndex, runs: DataFrame, k: int, min_gap_days: int) -> DataFrame:
    queries = analog_queries(index.signatures, runs, index.norm)
    return analog_topk_min_gap(analog_distance(queries, index.candidates), k, min_gap_days)


def match_weights(matches: DataFrame) -> DataFrame:
    """Inverse-distance weights that sum to 1 per run."""
    raw = 1.0 / (F.col("distance") + WEIGHT_EPSILON)
    return matches.withColumn("raw", raw).withColumn(
        "weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("run_id"))
    ).drop("raw")


def ensemble_inverse_distance(fc: DataFrame, matches: DataFrame) -> DataFrame:
    """Weighted sum of the matches' forecasts per run and day.

    Every match of a run is forecast over the same horizon, so no day is missing
    in one of them.
    """
    w = match_weights(matches).select("run_id", F.col("rank").cast("long").alias("param_id"),
                                      "weight")
    return (
        fc.join(w, ["run_id", "param_id"])
        .groupBy("run_id", "day")
        .agg(F.sum(F.col("forecast") * F.col("weight")).alias("forecast"))
    )


def match_windows(matches: DataFrame, train_start: dt.date) -> DataFrame:
    """Each distinct matched window once: runs that share a match share its tuning."""
    return (
        matches.select("series_id", "target_start", "target_end")
        .distinct()
        .select(
            F.concat_ws("@", "series_id", F.col("target_start").cast("string")).alias("run_id"),
            "series_id",
            F.lit(train_start).alias("train_start"),
            F.date_sub("target_start", 1).alias("train_end"),
            "target_start",
            "target_end",
        )
    )


@dataclass(frozen=True)
class AnalogForecast:
    matches: DataFrame   # with the tuned error and parameters of each match
    blended: DataFrame   # run_id, day, forecast


def analog_forecast(
    history: DataFrame,
    index: AnalogIndex,
    runs: DataFrame,
    calendar: DataFrame,
    train_start: dt.date,
    k: int = 3,
    min_gap_days: int = 14,
    n_trials: int = 50,
    seed: int = 42,
    anchors: DataFrame | None = None,
    overrides: dict[str, float] | None = None,
    months_forward: Column | None = None,
) -> AnalogForecast:
    """Blended forecast of every run over its whole horizon.

    A run whose matched windows have too little history to tune has its matches, with the number
    that failed, and no row in ``blended``; ``cut_to_horizon`` labels it ``none``.
    """
    matches = stage(find_analogs(index, runs, k, min_gap_days), "matches")
    windows = match_windows(matches, train_start)
    best = search_params(history, windows, calendar, MODEL_R, n_trials, seed, anchors).select(
        F.col("run_id").alias("window_run"),
        *PARAM_NAMES,
        F.col("abs_pct_err").alias("tune_abs_err"),
        F.col("signed_pct_err").alias("tune_signed_err"),
        F.col("actual_total").alias("tune_actual"),
        F.col("forecast_total").alias("tune_forecast"),
    )
    key = F.concat_ws("@", "series_id", F.col("target_start").cast("string"))
    tuned = matches.withColumn("window_run", key).join(best, "window_run", "left")
    whole = Window.partitionBy("run_id")
    failed = F.count_if(F.col("tune_abs_err").isNull()).over(whole)
    tuned = stage(tuned.withColumn("n_failed", failed).drop("window_run"), "tuned")
    usable = tuned.filter("n_failed = 0")
    fits = param_override(
        usable.select("run_id", F.col("rank").cast("long").alias("param_id"), *PARAM_NAMES),
        overrides,
    )
    live = runs.withColumn("train_end", F.col("known_through"))
    months = months_forward
    if months is None:
        months = months_spanned(F.col("forecast_start"), F.col("forecast_end")) + 1
    fit = fit_model(history, live, fits, calendar, MODEL_R)
    fc = forecast(fit, horizon_requests(runs, months), calendar)
    return AnalogForecast(tuned, ensemble_inverse_distance(fc, usable))


def cut_to_horizon(blended: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """The blended forecast up to the forecast end, labelled by its method.

    A run without one (no analog, or a match with too little history to tune) has a single row
    without a day, labelled ``none``.
    """
    ends = runs.select("run_id", "forecast_start", "forecast_end")
    cut = (
        blended.join(ends, "run_id")
        .filter(F.col("day").between(F.col("forecast_start"), F.col("forecast_end")))
        .select("run_id", "day", "forecast", F.lit(f"analog_k{k}").alias("model_used"))
    )
    return runs.select("run_id").join(cut, "run_id", "left").withColumn(
        "model_used", F.coalesce("model_used", F.lit("none"))
    )


def match_label(matches: DataFrame) -> DataFrame:
    """One line per run that names its matches in order of rank."""
    item = F.concat(
        F.date_format("origin", "yyyy-MM-dd"),
        F.lit("(d="), F.format_number(F.round("distance", 2), 2),
        F.lit(",err="), F.format_number(F.round("tune_abs_err", 1), 1), F.lit("%)"),
    )
    items = F.sort_array(F.collect_list(F.struct("rank", item.alias("item"))))
    return matches.groupBy("run_id").agg(items.alias("items")).select(
        "run_id", F.concat_ws(" | ", F.transform("items", lambda x: x["item"])).alias("analogs_used")
    )
