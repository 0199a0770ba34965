import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import brute
from tidecast.operators import calendar as c
from tidecast.operators import forecast as fo
from tidecast.operators import structural as st
from tidecast.operators import sweep as sw
from tidecast.schemas import HISTORY, PARAM_NAMES

START, END = dt.date(2020, 1, 1), dt.date(2023, 4, 12)
FORECAST = dt.date(2023, 11, 20)


def days(a, z):
    return [a + dt.timedelta(days=i) for i in range((z - a).days + 1)]


def noisy(seed, last=dt.date(2023, 12, 31)):
    rnd = random.Random(seed)
    out = []
    for i, d in enumerate(days(START, last)):
        v = 1000 * math.exp(0.0004 * i) * (1 + 0.1 * (d.weekday() == 0)) * (0.5 + rnd.random())
        out.append((d, 0.0 if d.weekday() > 4 or rnd.random() < 0.05 else v))
    return out


@pytest.fixture(scope="module")
def world(spark):
    cal = c.calendar_dimension(spark, dt.date(2019, 1, 1), dt.date(2025, 12, 31))
    holidays = [r.calendar_date for r in cal.filter("is_holiday = 1").collect()]
    data = {"a": noisy(1), "b": noisy(2)}
    history = spark.createDataFrame(
        [(s, d, v) for s, rows in data.items() for d, v in rows], HISTORY)
    runs = spark.createDataFrame(
        [(s, s, START, END if s == "a" else FORECAST, FORECAST if s == "b" else END)
         for s in data],
        "run_id string, series_id string, train_start date, train_end date, forecast_start date",
    ).withColumn("forecast_start", F.date_add("forecast_start", 1))
    return cal, holidays, data, history, runs


@pytest.mark.parametrize("spec", [st.MODEL_A, st.MODEL_B, st.MODEL_C, st.MODEL_R],
                         ids=lambda s: s.name)
def test_models_match_brute_force(spark, world, spec):
    cal, holidays, data, history, runs = world
    fit = st.fit_model(history, runs, st.default_fits(runs, spec), cal, spec)
    got = {}
    for r in fo.forecast(fit, fo.horizon_requests(runs, 2), cal).collect():
        got.setdefault(r.run_id, {})[r.day] = r.forecast
    for run in runs.collect():
        train = [(d, v) for d, v in data[run.series_id] if d <= run.train_end]
        start = run.forecast_start
        last = max(got[run.run_id])
        want = brute.forecast_one(train, holidays, spec, spec.defaults, start, last)
        assert got[run.run_id].keys() == want.keys()
        for d, v in want.items():
            assert got[run.run_id][d] == pytest.approx(v, rel=1e-9, abs=1e-9), (run.run_id, d)
            if d.weekday() > 4 or d in holidays:
                assert got[run.run_id][d] == 0


def test_staged_sweep_equals_single_fits(spark, world):
    cal, holidays, data, history, runs = world
    one = runs.filter("run_id = 'a'")
    grid = {p: [st.MODEL_A.defaults[p]] for p in PARAM_NAMES}
    grid |= {"recency_strength": [0.2, 1.0], "level_lookback_days": [30, 60],
             "interaction_shrinkage": [0.2, 0.5], "trend_seasonal_tilt": [0.0, 0.15]}
    fits = sw.expand_grid(one, grid)
    params = {r.param_id: r.asDict() for r in fits.collect()}
    assert sorted(params) == list(range(16))
    fit = st.fit_model(history, one, fits, cal, st.MODEL_A)
    got = {(r.param_id, r.day): r.forecast
           for r in fo.forecast(fit, fo.horizon_requests(one, 1), cal).collect()}
    start = END + dt.timedelta(days=1)
    train = [(d, v) for d, v in data["a"] if d <= END]
    for pid, q in params.items():
        want = brute.forecast_one(train, holidays, st.MODEL_A, q, start,
                                  dt.date(2023, 5, 12))
        for d, v in want.items():
            assert got[pid, d] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_planted_trend_and_weekday_factors(spark, world):
    cal, holidays, *_ = world
    a, b = math.log(500.0), 0.001
    factor = {0: 1.2, 1: 1.0, 2: 0.9, 3: 0.8, 4: 1.1}
    rows, p = [], 0
    for d in days(START, dt.date(2023, 3, 31)):
        work = d.weekday() < 5 and d not in holidays
        rows.append(("s", d, math.exp(a + b * p) if work else 0.0))
        p += work
    history = spark.createDataFrame(rows, HISTORY)
    runs = spark.createDataFrame(
        [("r", "s", START, dt.date(2023, 3, 31))],
        "run_id string, series_id string, train_start date, train_end date")
    spec = replace(st.MODEL_A, defaults={**st.MODEL_A.defaults, "dow_shrinkage": 0.0})
    fits = st.default_fits(runs, spec)
    train = st.training_rows(history, runs, cal, spec)
    line = st.fit_trend(train, fits).first()
    assert line.intercept == pytest.approx(a, abs=1e-9)
    assert line.slope == pytest.approx(b, rel=1e-9)

    # weekday factors alone, on a flat series with an undisturbed trend
    flat = spark.createDataFrame(
        [("s", d, 100.0 * factor.get(d.weekday(), 0.0)) for d in days(START, dt.date(2023, 3, 31))],
        HISTORY)
    train = st.training_rows(flat, runs, cal, spec)
    effects = st.fit_effects(train, st.with_step_keys(fits), spec).first()
    assert sum(effects.dow_effect.values()) / 5 == pytest.approx(1)
    for k, v in factor.items():
        assert effects.dow_effect[k] == pytest.approx(v, rel=5e-3)
    assert sum(effects.dom_effect.values()) / len(effects.dom_effect) == pytest.approx(1)
    assert sum(effects.moy_effect.values()) / len(effects.moy_effect) == pytest.approx(1)


def test_no_lookahead(spark, world):
    cal, _, _, history, runs = world
    one = runs.filter("run_id = 'a'")
    fits = st.default_fits(one, st.MODEL_A)
    later = history.withColumn(
        "amount", F.when(F.col("day") > F.lit(END), F.col("amount") * 7 + 1).otherwise(F.col("amount")))

    def run(h):
        fit = st.fit_model(h, one, fits, cal, st.MODEL_A)
        return {r.day: r.forecast for r in
                fo.forecast(fit, fo.horizon_requests(one, 1), cal).collect()}

    assert run(history) == run(later)


def test_run_without_december_still_forecasts(spark, world):
    cal, holidays, data, history, _ = world
    runs = spark.createDataFrame(
        [("r", "a", START, dt.date(2020, 8, 14), dt.date(2020, 8, 17))],
        "run_id string, series_id string, train_start date, train_end date, forecast_start date")
    fit = st.fit_model(history, runs, st.default_fits(runs, st.MODEL_C), cal, st.MODEL_C)
    got = {r.day: r.forecast for r in
           fo.forecast(fit, fo.horizon_requests(runs, 1), cal).collect()}
    train = [(d, v) for d, v in data["a"] if d <= dt.date(2020, 8, 14)]
    want = brute.forecast_one(train, holidays, st.MODEL_C, st.MODEL_C.defaults,
                              dt.date(2020, 8, 17), dt.date(2020, 9, 16))
    assert got == pytest.approx(want, rel=1e-9)


def test_halo_is_weekdays_around_holidays(spark, world):
    cal, holidays, *_ = world
    got = {r.day for r in st.holiday_halo(st.holiday_days(cal), 2, 4).collect()}
    want = {h + dt.timedelta(days=k) for h in holidays for k in range(-2, 5)}
    assert got == {d for d in want if d.weekday() < 5}
