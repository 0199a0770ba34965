"""Month-by-month choice of a model: by business days or by regime."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import month_start
from tidecast.operators.analog import anchor_lookup
from tidecast.operators.calendar import business_days_per_month
from tidecast.operators.forecast import forecast
from tidecast.operators.regime import (
    WEIGHTED_THRESHOLD,
    regime_label,
    regime_params,
    run_indicators,
    weighted_composite,
)
from tidecast.operators.structural import (
    MODEL_A,
    MODEL_B,
    MODEL_C,
    Fit,
    default_fits,
    fit_models,
)
from tidecast.staging import stage

OUTPUT = ["run_id", "day", "forecast", "model_used", "n_biz_days"]


def switch_months(runs: DataFrame, calendar: DataFrame, months_forward: int) -> DataFrame:
    """One request per run and month touched. The first starts at the forecast start,
    later ones at the first of their month; each horizon spans one month and is cut
    at the month's end after its seasonals are scaled."""
    i = F.col("req_id")
    moved = F.add_months(F.col("forecast_start"), i)
    start = F.when(i == 0, F.col("forecast_start")).otherwise(month_start(moved))
    return (
        runs.withColumn("req_id", F.explode(F.sequence(F.lit(0), F.lit(months_forward - 1))))
        .withColumn("start", start)
        .withColumn("end", F.date_sub(F.add_months("start", 1), 1))
        .withColumn("month", month_start(F.col("start")))
        .withColumn("slice_end", F.last_day("start"))
        .join(F.broadcast(business_days_per_month(calendar)), "month")
        .select("run_id", "req_id", "start", "end", "month", "slice_end", "n_biz_days")
    )


def _forecast_part(fit: Fit, calendar: DataFrame, part: DataFrame) -> DataFrame:
    fc = forecast(fit, part.select("run_id", "param_id", "req_id", "start", "end"), calendar)
    labels = part.select("run_id", "req_id", "param_id", "slice_end", "model_used", "n_biz_days")
    return (
        fc.join(labels, ["run_id", "req_id", "param_id"])
        .filter(F.col("day") <= F.col("slice_end"))
        .select(*OUTPUT)
    )


def switch_bizday(history: DataFrame, runs: DataFrame, calendar: DataFrame,
                  months_forward: int = 2, threshold: int = 22) -> DataFrame:
    """December takes model C, months of at least 22 business days A, others B."""
    choice = (
        F.when(F.month("month") == 12, F.lit("C"))
        .when(F.col("n_biz_days") >= threshold, F.lit("A"))
        .otherwise(F.lit("B"))
    )
    months = switch_months(runs, calendar, months_forward).withColumns(
        {"model_used": choice, "param_id": F.lit(0).cast("long")}
    )
    specs = [MODEL_A, MODEL_B, MODEL_C]
    parts = [months.filter(F.col("model_used") == s.name) for s in specs]
    fits = [default_fits(p.select("run_id").distinct(), s) for p, s in zip(parts, specs)]
    fitted = fit_models(history, runs, calendar, list(zip(specs, fits)))
    return reduce(DataFrame.unionByName, [
        _forecast_part(f, calendar, p) for f, p in zip(fitted, parts)])


def regime_requests(funnel: DataFrame, runs: DataFrame, calendar: DataFrame,
                    months_forward: int) -> DataFrame:
    """The month requests of every run with regime, model and parameter set.

    A run without funnel has no regime; its months outside December are labelled ``none``.
    """
    spark = runs.sparkSession
    scores = run_indicators(funnel, runs).select(
        "run_id", weighted_composite().alias("composite")
    )
    december = F.month("month") == 12
    regime = F.when(F.col("composite").isNotNull(), regime_label(
        F.month("month"), F.col("composite"), WEIGHTED_THRESHOLD))
    return (
        switch_months(runs, calendar, months_forward)
        .join(scores, "run_id", "left")
        .withColumn("regime", F.when(~december, regime))
        .join(F.broadcast(regime_params(spark)), "regime", "left")
        .withColumn("param_id", F.coalesce("param_id", F.lit(0).cast("long")))
        .withColumn(
            "model_used",
            F.when(december, F.lit("C"))
            .when(F.col("regime").isNull(), F.lit("none"))
            .otherwise(F.concat(F.lit("A("), F.col("regime"), F.lit(")"))),
        )
    )


def switch_regime(history: DataFrame, funnel: DataFrame, runs: DataFrame, calendar: DataFrame,
                  months_forward: int = 2) -> DataFrame:
    """December takes model C, other months model A with their regime's parameters.

    A month without a regime has a single row without a day.
    """
    spark = runs.sparkSession
    requests = stage(regime_requests(funnel, runs, calendar, months_forward), "requests")
    a = requests.filter("model_used NOT IN ('C', 'none')")
    fits_a = (
        a.select("run_id", "param_id").distinct()
        .join(F.broadcast(regime_params(spark).drop("regime")), "param_id")
    )
    c = requests.filter("model_used = 'C'")
    fits_c = default_fits(c.select("run_id").distinct(), MODEL_C)
    status = requests.filter("model_used = 'none'").select("run_id", "model_used").distinct()
    fitted = fit_models(history, runs, calendar, [(MODEL_A, fits_a), (MODEL_C, fits_c)])
    model_a, model_c = (_forecast_part(f, calendar, p) for f, p in zip(fitted, (a, c)))
    return model_a.unionByName(model_c).unionByName(status, allowMissingColumns=True)


def switch_dual_lookup(runs: DataFrame, anchors: DataFrame, funnel: DataFrame,
                       calendar: DataFrame, months_forward: int = 2) -> DataFrame:
    """Nearest anchor per run and month: January months from the January pool, other
    months from the rest. Months whose pool is empty drop."""
    months = switch_months(runs, calendar, months_forward)
    january = F.month("month") == 1
    first = months.filter(january).join(
        anchor_lookup(runs, anchors, funnel, force_month=1), "run_id")
    others = months.filter(~january).join(
        anchor_lookup(runs, anchors, funnel, force_month=2), "run_id")
    cols = ["run_id", "req_id", "month", "label", "distance"]
    return first.select(*cols).unionByName(others.select(*cols))
