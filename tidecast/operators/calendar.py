"""Calendar operators: spine, federal holidays, business-day dimension, run windows.

A calendar holds one row per day, so it is bounded by its date range (not by the
data) and small enough to broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import (
    business_day_add,
    is_weekday,
    month_start,
    nth_weekday_of_month,
)

# The eleven federal holidays. Fixed-date rules give a day of the
# month and move to the nearest weekday; the others give a weekday (Monday = 0)
# and its rank in the month, -1 for the last.
FEDERAL_HOLIDAY_RULES = (
    # name, month, day, weekday, rank, first year
    ("New Year's Day", 1, 1, None, None, 1871),
    ("Martin Luther King Jr. Day", 1, None, 0, 3, 1986),
    ("Presidents' Day", 2, None, 0, 3, 1971),
    ("Memorial Day", 5, None, 0, -1, 1971),
    ("Juneteenth", 6, 19, None, None, 2021),
    ("Independence Day", 7, 4, None, None, 1871),
    ("Labor Day", 9, None, 0, 1, 1894),
    ("Columbus Day", 10, None, 0, 2, 1971),
    ("Veterans Day", 11, 11, None, None, 1938),
    ("Thanksgiving", 11, None, 3, 4, 1942),
    ("Christmas", 12, 25, None, None, 1871),
)
_RULE_SCHEMA = "name string, month int, dom int, dow int, nth int, since int"


def calendar_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    days = F.sequence(F.lit(start), F.lit(end))
    return spark.range(1).select(F.explode(days).alias("calendar_date"))


def nearest_weekday(d: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    w = F.weekday(d)
    return F.date_add(d, F.when(w == 5, -1).when(w == 6, 1).otherwise(0))


def us_federal_holidays(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Observed federal holidays in [start, end]."""
    # one more year: New Year's Day on a Saturday is observed in December
    years = F.sequence(F.lit(start.year), F.lit(end.year + 1))
    rules = spark.createDataFrame(FEDERAL_HOLIDAY_RULES, _RULE_SCHEMA)
    fixed = nearest_weekday(F.make_date("y", "month", "dom"))
    floating = nth_weekday_of_month(F.col("y"), F.col("month"), F.col("nth"), F.col("dow"))
    return (
        rules.withColumn("y", F.explode(years))
        .filter(F.col("y") >= F.col("since"))
        .select(
            F.when(F.col("dom").isNotNull(), fixed).otherwise(floating).alias("calendar_date"),
            F.col("name").alias("holiday_name"),
        )
        .filter(F.col("calendar_date").between(F.lit(start), F.lit(end)))
    )


def holiday_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Daily spine with the hard holiday flag."""
    holidays = us_federal_holidays(spark, start, end).select(
        "calendar_date", F.lit(1).alias("is_holiday")
    )
    return (
        calendar_spine(spark, start, end)
        .join(F.broadcast(holidays), "calendar_date", "left")
        .select("calendar_date", F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"))
    )


def calendar_dimension(
    spark: SparkSession,
    start: dt.date,
    end: dt.date,
    company_holidays: DataFrame | None = None,
) -> DataFrame:
    """One row per day. Our definitions: a business day is a weekday that is neither
    a federal nor a company holiday, funding happens on business days,
    ``biz_days_in_month`` counts weekdays, and "remaining" counts later days only."""
    cal = holiday_calendar(spark, start, end)
    if company_holidays is None:
        cal = cal.withColumn("is_company_holiday", F.lit(0))
    else:
        closed = company_holidays.select("calendar_date", F.lit(1).alias("closed")).distinct()
        cal = cal.join(F.broadcast(closed), "calendar_date", "left").select(
            "calendar_date", "is_holiday",
            F.coalesce("closed", F.lit(0)).alias("is_company_holiday"),
        )
    d = F.col("calendar_date")
    cal = cal.withColumn("is_weekday", is_weekday(d).cast("int"))
    open_day = (
        (F.col("is_weekday") == 1)
        & (F.col("is_holiday") == 0)
        & (F.col("is_company_holiday") == 0)
    ).cast("int")
    month = Window.partitionBy(month_start(d))
    later = month.orderBy("calendar_date").rowsBetween(1, Window.unboundedFollowing)
    return cal.withColumns({"biz_day": open_day, "funding_day": open_day}).select(
        "calendar_date",
        "is_weekday",
        "is_holiday",
        "is_company_holiday",
        "biz_day",
        "funding_day",
        F.sum("is_weekday").over(month).cast("int").alias("biz_days_in_month"),
        F.coalesce(F.sum("biz_day").over(later), F.lit(0)).cast("int").alias(
            "biz_day_remaining_in_month"
        ),
        F.coalesce(F.sum("funding_day").over(later), F.lit(0)).cast("int").alias(
            "funding_day_remaining_in_month"
        ),
        F.datediff(F.last_day(d), d).alias("calendar_days_remaining"),
    )


def nth_future_bizday_bound(calendar: DataFrame, today: dt.date, n: int) -> DataFrame:
    """One row: the ``n``-th business day after ``today``. An error if the calendar ends before."""
    ahead = calendar.filter((F.col("calendar_date") > F.lit(today)) & (F.col("biz_day") == 1))
    first = ahead.select("calendar_date").orderBy("calendar_date").limit(n)
    short = F.raise_error(F.lit(f"the calendar has fewer than {n} business days after {today}"))
    return first.agg(
        F.when(F.count("*") == n, F.max("calendar_date")).otherwise(short.cast("date")).alias("upper_bound")
    )


def business_days_per_month(calendar: DataFrame) -> DataFrame:
    """Weekdays that are no federal holiday, per month."""
    return calendar.groupBy(month_start(F.col("calendar_date")).alias("month")).agg(
        F.count_if((F.weekday("calendar_date") < 5) & (F.col("is_holiday") == 0))
        .cast("int")
        .alias("n_biz_days")
    )


def business_day_count(windows: DataFrame, calendar: DataFrame, start: str, end: str,
                       name: str = "n_biz_days") -> DataFrame:
    """Weekdays that are no federal holiday in each window, both ends included."""
    work = calendar.filter((F.weekday("calendar_date") < 5) & (F.col("is_holiday") == 0))
    counted = (
        windows.select(start, end)
        .distinct()
        .withColumn("calendar_date", F.explode(F.sequence(start, end)))
        .join(F.broadcast(work.select("calendar_date", F.lit(1).alias("one"))),
              "calendar_date", "left")
        .groupBy(start, end)
        .agg(F.count("one").cast("int").alias(name))
    )
    return windows.join(counted, [start, end])


def run_windows(
    todays: DataFrame,
    train_start: dt.date,
    horizon_biz_days: int = 20,
    known_biz_days: int = 3,
    output_biz_days: int = 29,
) -> DataFrame:
    """Dates of every run from rows (series_id, today)."""
    today = F.col("today")
    start = business_day_add(today, known_biz_days + 1)
    return todays.select(
        F.concat_ws("@", "series_id", today.cast("string")).alias("run_id"),
        "series_id",
        "today",
        F.lit(train_start).alias("train_start"),
        business_day_add(today, known_biz_days).alias("known_through"),
        start.alias("forecast_start"),
        business_day_add(start, horizon_biz_days - 1).alias("forecast_end"),
        business_day_add(today, output_biz_days).alias("output_through"),
    )
