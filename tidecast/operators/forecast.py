"""Horizon forecasts of fitted models, for many runs and parameter sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import month_start
from tidecast.functions.numeric import clip
from tidecast.operators.structural import (
    Fit,
    ModelSpec,
    days_near_holidays,
    distortion_slot,
    holiday_days,
    interaction,
    lookup,
    seasonal_product,
)
from tidecast.staging import join_sharded, sharded


def horizon_requests(runs: DataFrame, months_forward: Column | int = 1,
                     start: str = "forecast_start") -> DataFrame:
    """One horizon per run: from its start for whole months, less a day."""
    n = F.lit(months_forward) if isinstance(months_forward, int) else months_forward
    return runs.select(
        "run_id",
        F.lit(0).alias("req_id"),
        F.col(start).alias("start"),
        F.date_sub(F.add_months(F.col(start), n), 1).alias("end"),
    )


def forecast_horizon(requests: DataFrame) -> DataFrame:
    """Unfold every request into days; ``h`` is the day's index."""
    return requests.withColumn("day", F.explode(F.sequence("start", "end"))).withColumn(
        "h", F.datediff("day", "start")
    )


def horizon_distortion_keys(days: DataFrame, calendar: DataFrame, spec: ModelSpec) -> DataFrame:
    """(holiday weekday, offset) that applies to a day: the latest holiday wins.

    Holidays count from shortly before the horizon to its end.
    """
    near = days_near_holidays(days, "day", holiday_days(calendar), spec).filter(
        F.col("holiday").between(
            F.date_sub("start", 2 * (spec.holiday_before + 1)), F.col("end")
        )
    )
    if spec.mon_thu_fraction is not None:
        near = near.filter(~((F.col("holiday_dow") == 0) & (F.col("offset") == 3)))
    return near.groupBy("run_id", "req_id", "day").agg(
        F.max_by(
            distortion_slot(spec, F.col("holiday_dow"), F.col("offset")),
            F.struct("holiday", "offset"),
        ).alias("slot")
    )


def _mom_weight(spec: ModelSpec) -> Column:
    """Last year's step into the same month, damped and clipped; 1 where unknown."""
    month = month_start(F.col("day"))
    totals = F.col("monthly_totals")
    last_year = F.add_months(month, -12)
    # the step into a January is measured a year further back
    before = F.add_months(month, -13)
    same = F.when(F.month(month) > 1, last_year).otherwise(F.add_months(month, -24))
    prev, pp, yoy = (F.try_element_at(totals, d) for d in (before, same, last_year))
    known = prev.isNotNull() & pp.isNotNull() & yoy.isNotNull() & (prev > 0) & (pp > 0)
    weight = clip(1 + spec.mom_dampening * (prev / pp - 1), 0.85, 1.15)
    return F.when(known, weight).otherwise(1.0)


def mom_trend_weight(monthly_totals: DataFrame, requests: DataFrame, spec: ModelSpec) -> DataFrame:
    """``run_id, month, weight`` of every month that a request touches, from ``fit_monthly_totals``."""
    months = forecast_horizon(requests).select("run_id", month_start(F.col("day")).alias("day"))
    totals = monthly_totals.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "total"))).alias("monthly_totals")
    )
    return months.distinct().join(totals, "run_id", "left").select(
        "run_id", F.col("day").alias("month"), _mom_weight(spec).alias("weight")
    )


def forecast(fit: Fit, requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Forecast each request with every parameter set fitted for its run.

    ``requests`` holds run_id, req_id, start, end and, to pick one parameter set,
    param_id. Seasonals are scaled by their mean over the whole request, zero
    weekends included, so a result may be cut only afterwards.
    """
    spec = fit.spec
    days = forecast_horizon(requests)
    holidays = F.broadcast(
        holiday_days(calendar).select(F.col("calendar_date").alias("day"),
                                      F.lit(True).alias("is_holiday"))
    )
    flagged = (
        days.join(holidays, "day", "left")
        .join(
            horizon_distortion_keys(
                days.select("run_id", "req_id", "start", "end", "day").distinct(), calendar, spec
            ),
            ["run_id", "req_id", "day"],
            "left",
        )
        .withColumns(
            {
                "dow": F.weekday("day"),
                "dom": F.dayofmonth("day"),
                "moy": F.month("day"),
                "is_holiday": F.coalesce("is_holiday", F.lit(False)),
            }
        )
    )
    if "param_id" in requests.columns:
        rows = flagged.join(fit.model, ["run_id", "param_id"]).withColumn("shard", F.lit(0))
    else:
        shards = sharded(fit.fits.select("run_id", "param_id"), "param_id")
        rows = join_sharded(sharded(fit.model, "param_id"), flagged, shards)
    dow, dom, moy = F.col("dow"), F.col("dom"), F.col("moy")
    request = Window.partitionBy("run_id", "shard", "param_id", "req_id")
    rows = rows.withColumn("seasonal", seasonal_product(spec, dow, dom, moy, True))
    rows = rows.withColumn(
        "seasonal", F.try_divide(F.col("seasonal"), F.avg("seasonal").over(request))
    )
    scaled = F.pow("seasonal", "seasonal_exponent")
    step = F.col("n_train") + F.col("h")
    trend = F.exp(F.col("intercept") + F.col("slope") * F.col("trend_dampening") * step)
    value = (
        F.col("base_level")
        * scaled
        * trend
        * (1 + F.col("trend_seasonal_tilt") * (scaled - 1))
        * (1 + F.col("forward_lift_daily") * F.col("h"))
    )
    if spec.mom_dampening:
        value = value * _mom_weight(spec)
    if spec.cliff_day is not None:
        ratio = F.col("cliff_ratio")
        past = (moy == 12) & (dom > spec.cliff_day)
        value = value * F.when(past, ratio + (1 - ratio) * spec.cliff_shrinkage).otherwise(1.0)
    factor = lookup("distortion", F.col("slot"))
    value = F.when((dow >= 5) | F.col("is_holiday"), F.lit(0.0)).otherwise(value * factor)
    if spec.woy_cliff:
        woy = F.weekofyear("day")
        guard = lookup("woy_factor", woy * 5 + dow)
        active = (dow < 5) & woy.isin(*spec.woy_weeks)
        value = value * F.when(active, guard).otherwise(1.0)
    rows = rows.withColumn("forecast", value * spec.target_scale)
    if spec.mon_thu_fraction is not None:
        rows = _mon_thu_override(rows, calendar, spec, trend)
    return rows.select(
        "run_id", "param_id", "req_id", "start", "end", "day", "h", "is_holiday", "seasonal",
        "forecast",
    )


def _mon_thu_override(rows: DataFrame, calendar: DataFrame, spec: ModelSpec,
                      trend: Column) -> DataFrame:
    """The Thursday after a Monday holiday is a fraction of a Monday's expectation."""
    mondays = holiday_days(calendar).filter(F.weekday("calendar_date") == 0)
    thursdays = mondays.select(
        F.date_add("calendar_date", 3).alias("day"),
        F.col("calendar_date").alias("monday"),
    )
    in_reach = F.col("monday").between(
        F.date_sub("start", 2 * (spec.holiday_before + 1)), F.col("end")
    )
    expected = (
        F.col("base_level") * trend * lookup("dom_effect", F.col("dom"))
        * lookup("moy_effect", F.col("moy")) * lookup("dow_effect", F.lit(0))
        * interaction(F.lit(0), F.col("moy"))
    )
    return rows.join(F.broadcast(thursdays), "day", "left").withColumn(
        "forecast",
        F.when(
            F.col("monday").isNotNull() & in_reach,
            spec.mon_thu_fraction * expected * spec.target_scale,
        ).otherwise(F.col("forecast")),
    )


def slice_forecast(fc: DataFrame, until: str = "forecast_end") -> DataFrame:
    return fc.filter(F.col("day") <= F.col(until))

