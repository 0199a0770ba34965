"""Many series, many runs and many parameter sets: results against brute force, and the plan."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from tidecast.operators import calendar as c
from tidecast.operators import forecast as fo
from tidecast.operators import structural as st
from tidecast.operators import sweep as sw
from tidecast.schemas import HISTORY

START, END = dt.date(2021, 1, 4), dt.date(2023, 3, 31)


def planted(seed):
    rnd = random.Random(seed)
    level, slope, monday = 500 + 50 * seed, rnd.uniform(-2e-4, 4e-4), rnd.uniform(0.8, 1.5)
    out = []
    for i in range((END - START).days + 1):
        d = START + dt.timedelta(days=i)
        v = level * math.exp(slope * i) * (monday if d.weekday() == 0 else 1) * rnd.uniform(0.8, 1.2)
        out.append((d, 0.0 if d.weekday() > 4 else v))
    return out


@pytest.fixture(scope="module")
def world(spark):
    cal = c.calendar_dimension(spark, dt.date(2020, 1, 1), dt.date(2024, 12, 31))
    data = {f"s{i:03d}": planted(i) for i in range(200)}
    history = spark.createDataFrame([(s, d, v) for s, rows in data.items() for d, v in rows], HISTORY)
    rows = []
    for s in data:
        for k in range(20):
            last = dt.date(2022, 5, 2) + dt.timedelta(days=13 * k)
            rows.append((f"{s}@{k:02d}", s, START, last, last + dt.timedelta(days=1)))
    runs = spark.createDataFrame(
        rows, "run_id string, series_id string, train_start date, train_end date, forecast_start date")
    return cal, data, history, runs


def test_200_series_and_20_runs_match_brute_force(spark, world):
    cal, data, history, runs = world
    holidays = [r.calendar_date for r in cal.filter("is_holiday = 1").collect()]
    fit = st.fit_model(history, runs, st.default_fits(runs, st.MODEL_R), cal, st.MODEL_R)
    fc = fo.forecast(fit, fo.horizon_requests(runs, 1), cal)
    assert fc.select("run_id").distinct().count() == 4000
    rnd = random.Random(1)
    chosen = {f"s{rnd.randrange(200):03d}@{rnd.randrange(20):02d}" for _ in range(40)}
    got = {}
    for r in fc.filter(F.col("run_id").isin(*chosen)).collect():
        got.setdefault(r.run_id, {})[r.day] = r.forecast
    for run in runs.filter(F.col("run_id").isin(*chosen)).collect():
        train = [(d, v) for d, v in data[run.series_id] if d <= run.train_end]
        want = brute.forecast_one(train, holidays, st.MODEL_R, st.MODEL_R.defaults,
                                  run.forecast_start, max(got[run.run_id]))
        assert set(want) == set(got[run.run_id])
        for d, v in want.items():
            assert got[run.run_id][d] == pytest.approx(v, rel=1e-8, abs=1e-6)


def exchanges_by_run_alone(plan):
    """Subtrees below each exchange whose only key is the run."""
    lines = plan.split("== Physical Plan ==")[1].splitlines()
    depth = [len(re.match(r"[\s:+|-]*", x).group()) for x in lines]
    for i, line in enumerate(lines):
        if re.search(r"hashpartitioning\(run_id#\d+L?, \d+\)", line):
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                j += 1
            yield "\n".join(lines[i:j])


def test_parameters_are_not_exchanged_by_run_alone(spark, world):
    cal, _, history, runs = world
    one = runs.filter("run_id = 's000@19'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fits = sw.expand_grid(one, sw.MONTHLY_GRID)
        fit = st.fit_model(history, one, fits, cal, st.MODEL_A)
        fc = fo.forecast(fit, fo.horizon_requests(one, 1), cal)
        plan = fc._jdf.queryExecution().toString()
        assert fc.select("param_id").distinct().count() == fits.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(run_id#" in plan
    for below in exchanges_by_run_alone(plan):
        assert "base_level" not in below and "trend_dampening" not in below
