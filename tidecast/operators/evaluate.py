"""Stitch, evaluate and report forecasts against actuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.predicates import known_override, source_label
from tidecast.operators.selection import exact_median
from tidecast.staging import days_of

RUN_DATES = ["run_id", "series_id", "today", "known_through", "output_through"]


def run_actuals(history: DataFrame, runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Actual amounts of every run's series within the run's own dates."""
    spans = days_of(runs.withColumns({"_from": lo, "_to": hi}), "_from", "_to").drop("_from", "_to")
    return spans.join(history, ["series_id", "day"]).withColumnRenamed("amount", "actual")


def stitch_actual_forecast(history: DataFrame, fc: DataFrame, runs: DataFrame) -> DataFrame:
    """Known actuals, then the forecast; weekdays only."""
    known = run_actuals(history, runs, F.col("today"), F.col("known_through")).select(
        "run_id", "series_id", "day", F.col("actual").alias("amount"),
        F.lit("actual").alias("source"), F.lit("-").alias("model_used"),
    )
    ahead = fc.join(runs.select("run_id", "series_id"), "run_id").select(
        "run_id", "series_id", "day", F.col("forecast").alias("amount"),
        F.lit("forecast").alias("source"), "model_used",
    )
    return known.unionByName(ahead, allowMissingColumns=True).filter(F.weekday("day") < 5)


def join_actual_forecast(fc: DataFrame, actuals: DataFrame, how: str) -> DataFrame:
    return fc.join(actuals.select("run_id", "day", "actual"), ["run_id", "day"], how)


def eval_frame(history: DataFrame, fc: DataFrame, runs: DataFrame, mode: str = "inner",
               view_to: str = "output_through") -> DataFrame:
    """Forecast against actual per weekday.

    ``inner`` keeps days with a positive actual, ``left`` all days with a positive
    forecast. Within the known window the forecast is replaced by the actual.
    """
    actuals = run_actuals(history, runs, F.col("today"), F.col(view_to))
    dates = runs.select("run_id", "series_id", "known_through", F.col(view_to).alias("view_to"))
    rows = (
        join_actual_forecast(fc, actuals, mode)
        .join(dates, "run_id")
        .filter((F.col("day") <= F.col("view_to")) & (F.weekday("day") < 5))
    )
    keep = "actual" if mode == "inner" else "forecast"
    rows = rows.filter(F.col(keep) > 0).withColumn(
        "source", source_label(F.col("day"), F.col("known_through"))
    )
    rows = known_override(rows, "day", "known_through")
    diff = F.col("forecast") - F.col("actual")
    return rows.withColumn("diff", diff).select(
        "run_id", "series_id", "day", "source", "model_used", "actual", "forecast", "diff",
        F.when(F.col("actual") > 0, F.col("diff") / F.col("actual") * 100).alias("pct_err"),
    )


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order ('actual' sorts before 'forecast')."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def report_rows(history: DataFrame, ev: DataFrame, runs: DataFrame,
                view_to: str = "output_through") -> DataFrame:
    """Known rows and forecast rows of the view window, one per day."""
    known = (
        run_actuals(history, runs, F.col("today"), F.col("known_through"))
        .filter((F.weekday("day") < 5) & (F.col("actual") > 0))
        .select(
            "run_id", "series_id", "day", F.lit("actual").alias("source"),
            F.lit("actual").alias("model_used"), "actual", F.col("actual").alias("forecast"),
            F.lit(0.0).alias("diff"), F.lit(0.0).alias("pct_err"),
        )
    )
    both = known.unionByName(ev.filter("source = 'forecast'"))
    view = runs.select("run_id", "today", F.col(view_to).alias("view_to"))
    return (
        dedupe_first(both, ["run_id", "day"], ["source"])
        .join(view, "run_id")
        .filter(F.col("day").between(F.col("today"), F.col("view_to")))
        .drop("today", "view_to")
    )


def error_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals, difference, MAE and MAPE of the forecast rows.

    The forecast total covers every forecast row, the other figures only rows with
    an actual.
    """
    ahead = F.col("source") == "forecast"
    scored = ahead & (F.col("actual") > 0)
    out = rows.groupBy(*keys).agg(
        F.sum(F.when(scored, F.col("actual"))).alias("total_actual"),
        F.sum(F.when(ahead, F.col("forecast"))).alias("total_forecast"),
        F.avg(F.when(scored, F.abs("diff"))).alias("mae"),
        F.avg(F.when(scored, F.abs("pct_err"))).alias("mape"),
        F.count_if(scored).alias("n_scored"),
    )
    return out.withColumn("total_diff", F.col("total_forecast") - F.col("total_actual")).withColumn(
        "total_pct", F.try_divide("total_diff", "total_actual") * 100
    )


def report_frame(history: DataFrame, ev: DataFrame, runs: DataFrame,
                 view_to: str = "output_through") -> DataFrame:
    """Report rows followed by a TOTAL, a MAE and a MAPE row per run.

    The days and the three summary rows come out of one grouping, so the rows are
    not computed twice.
    """
    rows = report_rows(history, ev, runs, view_to)
    w = Window.partitionBy("run_id")
    ahead = F.col("source") == "forecast"
    scored = ahead & (F.col("actual") > 0)
    t_actual = F.sum(F.when(scored, F.col("actual"))).over(w)
    t_forecast = F.sum(F.when(ahead, F.col("forecast"))).over(w)
    first = F.row_number().over(w.orderBy("day")) == 1
    none = F.lit(None)

    def entry(kind: str, **cols: Column) -> Column:
        names = ["day", "source", "model_used", "actual", "forecast", "diff", "pct_err"]
        types = ["date", "string", "string", "double", "double", "double", "double"]
        vals = [cols.get(n, none).cast(t).alias(n) for n, t in zip(names, types)]
        return F.struct(F.lit(kind).alias("row_type"), *vals)

    x = rows.withColumns(
        {
            "t_actual": t_actual,
            "t_forecast": t_forecast,
            "mae": F.avg(F.when(scored, F.abs("diff"))).over(w),
            "mape": F.avg(F.when(scored, F.abs("pct_err"))).over(w),
            "is_first": first,
        }
    )
    c = F.col
    day = entry("day", **{n: c(n) for n in
                          ["day", "source", "model_used", "actual", "forecast", "diff", "pct_err"]})
    total = entry(
        "TOTAL",
        source=F.lit("forecast only"),
        actual=c("t_actual"),
        forecast=c("t_forecast"),
        diff=c("t_forecast") - c("t_actual"),
        pct_err=F.try_divide(c("t_forecast") - c("t_actual"), c("t_actual")) * 100,
    )
    summary = F.array(day, total, entry("MAE", forecast=c("mae")),
                      entry("MAPE", forecast=c("mape")))
    entries = F.when(c("is_first"), summary).otherwise(F.array(day))
    return x.select("run_id", "series_id", F.explode(entries).alias("e")).select(
        "run_id", "series_id", "e.*"
    )


def month_end_view(history: DataFrame, fc: DataFrame, runs: DataFrame) -> DataFrame:
    """Known actuals and positive forecasts up to the month's end, with run totals."""
    month_end = F.last_day("today")
    known = (
        run_actuals(history, runs, F.col("today"), F.col("known_through"))
        .filter(F.col("actual") > 0)
        .select("run_id", "day", F.col("actual").alias("amount"),
                F.lit("actual").alias("source"), F.lit("actual").alias("model_used"))
    )
    ahead = fc.filter(F.col("forecast") > 0).select(
        "run_id", "day", F.col("forecast").alias("amount"), F.lit("forecast").alias("source"),
        "model_used",
    )
    rows = dedupe_first(
        known.unionByName(ahead).filter(F.weekday("day") < 5), ["run_id", "day"], ["source"]
    )
    w = Window.partitionBy("run_id")
    return (
        rows.join(runs.select("run_id", "series_id", "today"), "run_id")
        .filter(F.col("day").between(F.col("today"), month_end))
        .withColumn(
            "actual_total", F.sum(F.when(F.col("source") == "actual", F.col("amount"))).over(w)
        )
        .withColumn(
            "forecast_total", F.sum(F.when(F.col("source") == "forecast", F.col("amount"))).over(w)
        )
        .withColumn("grand_total", F.sum("amount").over(w))
        .drop("today")
    )


def within_bands(rows: DataFrame, err: str, *keys: str,
                 bands: tuple[int, ...] = (5, 10, 15),
                 extra: list[Column] | None = None) -> DataFrame:
    """Mean, median and maximum absolute error and the count within each band.

    The median comes from counts, so a group may hold any number of rows.
    """
    a = F.abs(F.col(err))
    stats = rows.groupBy(*keys).agg(
        F.count(err).alias("n"),
        F.avg(a).alias("mean_abs_err"),
        F.max(a).alias("max_abs_err"),
        *[F.count_if(a <= b).alias(f"within_{b}") for b in bands],
        *(extra or []),
    )
    medians = exact_median(rows, list(keys), a, "median_abs_err")
    if not keys:
        return stats.join(medians, how="left", on=F.lit(True))
    same = [stats[k].eqNullSafe(medians[k]) for k in keys]
    return stats.join(medians, same, "left").drop(*[medians[k] for k in keys])
