import datetime as dt

import pytest
from pyspark.sql import functions as F

from brute import weekdays_step
from tidecast.functions.dates import business_day_add, months_spanned, week_of_month
from tidecast.operators import calendar as c
from tidecast.staging import days_of


def test_federal_holiday_counts(spark):
    h = c.us_federal_holidays(spark, dt.date(2021, 1, 1), dt.date(2030, 12, 31))
    days = [r.calendar_date for r in h.collect()]
    assert len(days) == 110
    assert all(d.weekday() < 5 for d in days)
    assert dt.date(2021, 6, 18) in days and dt.date(2021, 12, 31) in days
    assert c.us_federal_holidays(spark, dt.date(1995, 1, 1), dt.date(2001, 12, 31)).count() == 70


def test_business_day_add_matches_stepping(spark):
    spine = c.calendar_spine(spark, dt.date(2023, 12, 20), dt.date(2024, 3, 10))
    steps = list(range(-12, 0)) + list(range(1, 31))
    rows = spine.withColumn("n", F.explode(F.array(*[F.lit(n) for n in steps])))
    for r in rows.withColumn("hit", business_day_add(F.col("calendar_date"), F.col("n"))).collect():
        assert r.hit == weekdays_step(r.calendar_date, r.n), r


def test_week_of_month_counts_sundays(spark):
    spine = c.calendar_spine(spark, dt.date(2022, 1, 1), dt.date(2024, 12, 31))
    for r in spine.withColumn("w", week_of_month(F.col("calendar_date"))).collect():
        first = r.calendar_date.replace(day=1)
        days = [first + dt.timedelta(days=i) for i in range(1, r.calendar_date.day)]
        assert r.w == 1 + sum(d.weekday() == 6 for d in days)


def test_dimension_on_a_known_month(spark):
    closed = spark.createDataFrame([(dt.date(2024, 11, 29),)], "calendar_date date")
    cal = c.calendar_dimension(spark, dt.date(2024, 11, 1), dt.date(2024, 11, 30), closed)
    by_day = {r.calendar_date: r for r in cal.collect()}
    assert by_day[dt.date(2024, 11, 28)].is_holiday == 1
    assert by_day[dt.date(2024, 11, 29)].is_company_holiday == 1
    assert sum(r.biz_day for r in by_day.values()) == 18  # 21 weekdays, 2 + 1 holidays
    assert by_day[dt.date(2024, 11, 1)].biz_days_in_month == 21
    assert by_day[dt.date(2024, 11, 27)].biz_day_remaining_in_month == 0
    assert by_day[dt.date(2024, 11, 1)].calendar_days_remaining == 29


def test_run_windows(spark):
    t = spark.createDataFrame([("s", dt.date(2026, 3, 30))], "series_id string, today date")
    r = c.run_windows(t, dt.date(2021, 9, 1)).first()
    assert r.known_through == dt.date(2026, 4, 2)
    assert r.forecast_start == dt.date(2026, 4, 3)
    assert r.forecast_end == weekdays_step(r.forecast_start, 19)
    assert r.output_through == weekdays_step(dt.date(2026, 3, 30), 29)


def test_months_spanned(spark):
    d = spark.createDataFrame(
        [(dt.date(2024, 12, 31), dt.date(2025, 1, 1)), (dt.date(2024, 5, 1), dt.date(2024, 5, 31))],
        "a date, b date")
    assert [r.m for r in d.select(months_spanned(F.col("a"), F.col("b")).alias("m")).collect()] == [2, 1]


def test_bound_needs_a_calendar_that_reaches_it(spark):
    cal = c.calendar_dimension(spark, dt.date(2024, 1, 1), dt.date(2024, 3, 8))
    assert c.nth_future_bizday_bound(cal, dt.date(2024, 3, 4), 3).first()[0] == dt.date(2024, 3, 7)
    with pytest.raises(Exception, match="fewer than 5 business days"):
        c.nth_future_bizday_bound(cal, dt.date(2024, 3, 4), 5).collect()


def test_days_of_unfolds_only_real_spans(spark):
    runs = spark.createDataFrame(
        [("a", dt.date(2024, 2, 28), dt.date(2024, 3, 1)), ("b", dt.date(2024, 3, 2), dt.date(2024, 3, 1)),
         ("c", dt.date(2024, 3, 2), None)], "run_id string, lo date, hi date")
    got = [(r.run_id, r.day) for r in days_of(runs, "lo", "hi").orderBy("day").collect()]
    assert got == [("a", dt.date(2024, 2, 28)), ("a", dt.date(2024, 2, 29)), ("a", dt.date(2024, 3, 1))]
