"""Daily history: dated amounts per channel on a dense calendar, with weights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import week_of_month
from tidecast.functions.numeric import ratio_or_null
from tidecast.functions.predicates import channel_kept, normalized_channel, weekend_zero
from tidecast.operators.calendar import nth_future_bizday_bound
from tidecast.staging import stage

WEIGHT_COLUMNS = [
    "week_weight",
    "day_of_week_weight",
    "day_of_month_weight",
    "week_amount_weight",
    "day_of_week_amount_weight",
    "day_of_month_amount_weight",
    "month_to_month_weight_loans",
    "month_to_month_weight_amount",
    "month_within_year_weight_loans",
    "month_within_year_weight_amount",
]
MEASURES = ["number_of_loans", "total_loan_amount"]


# Fixed value: the history reaches this many business days past today.
AHEAD_BIZ_DAYS = 3

def channels(loans: DataFrame) -> DataFrame:
    return (
        loans.filter(channel_kept(F.col("channel")))
        .select(normalized_channel(F.col("channel")).alias("channel"))
        .distinct()
    )


def reduced_loans(loans: DataFrame, calendar: DataFrame, today: dt.date, years: int = 5,
                  ahead_biz_days: int = AHEAD_BIZ_DAYS) -> DataFrame:
    """Loans and amount per channel and funding day: the only pass over the fact.

    Loans without a date in the trailing years count under a null day, so the channels of all
    loans are in the same small table. Partial sums run before the shuffle, so a channel that
    holds a third of all loans still arrives as one row per day and input task.
    """
    bound = nth_future_bizday_bound(calendar, today, ahead_biz_days).scalar()
    day = F.col("funded_date")
    inside = (day >= F.add_months(F.lit(today), -12 * years)) & (day <= bound)
    return (
        loans.filter(channel_kept(F.col("channel")))
        .groupBy(normalized_channel(F.col("channel")).alias("channel"),
                 F.when(inside, day).alias("funded_date"))
        .agg(
            F.count("*").alias("number_of_loans"),
            F.sum("loan_amount").cast("decimal(28,2)").alias("total_loan_amount"),
        )
    )


def funded_per_day(loans: DataFrame, calendar: DataFrame, today: dt.date, years: int = 5,
                   ahead_biz_days: int = AHEAD_BIZ_DAYS) -> DataFrame:
    """Loans and amount per channel and funding day of the trailing years."""
    return reduced_loans(loans, calendar, today, years, ahead_biz_days).filter(
        F.col("funded_date").isNotNull())


def calendar_weights(per_day: DataFrame) -> DataFrame:
    """Weights of a day in its week, month and year, from weekday loans only.

    All windows start with the channel, so one exchange by channel serves them.
    Within a month, a (week, weekday) pair and a day number both name one date,
    so those two totals are the day's own.
    """
    d = F.col("funded_date")
    work = F.weekday(d) < 5
    rows = (
        per_day.repartition("channel")
        .withColumns({"y": F.year(d), "m": F.month(d), "w": week_of_month(d)})
        .withColumns(
            {
                "n": F.when(work, F.col("number_of_loans")).otherwise(0),
                "a": F.when(work, F.coalesce("total_loan_amount", F.lit(0))).otherwise(0)
                .cast("decimal(28,2)"),
            }
        )
    )
    week = Window.partitionBy("channel", "y", "m", "w")
    month = Window.partitionBy("channel", "y", "m")
    moy = Window.partitionBy("channel", "m")
    year = Window.partitionBy("channel", "y")
    rows = rows.withColumns(
        {
            "n_month": F.sum("n").over(month),
            "a_month": F.sum("a").over(month),
            "n_week": F.sum("n").over(week),
            "a_week": F.sum("a").over(week),
            "n_year": F.sum("n").over(year),
            "a_year": F.sum("a").over(year),
            "n_moy": F.sum("n").over(moy),
            "a_moy": F.sum("a").over(moy),
        }
    )
    c = F.col
    return rows.select(
        "channel",
        "funded_date",
        "number_of_loans",
        "total_loan_amount",
        ratio_or_null(c("n_week"), c("n_month")).alias("week_weight"),
        ratio_or_null(c("n"), c("n_week")).alias("day_of_week_weight"),
        ratio_or_null(c("n"), c("n_month")).alias("day_of_month_weight"),
        ratio_or_null(c("a_week"), c("a_month")).alias("week_amount_weight"),
        ratio_or_null(c("a"), c("a_week")).alias("day_of_week_amount_weight"),
        ratio_or_null(c("a"), c("a_month")).alias("day_of_month_amount_weight"),
        # the total is constant within its partition: the ratio is 1 / grouped rows
        ratio_or_null(c("n_moy"), F.sum("n_moy").over(moy)).alias("month_to_month_weight_loans"),
        ratio_or_null(c("a_moy"), F.sum(c("a_moy").cast("decimal(38,2)")).over(moy)).alias(
            "month_to_month_weight_amount"
        ),
        # all-years month total over one year's total: may exceed 1
        ratio_or_null(c("n_moy"), c("n_year")).alias("month_within_year_weight_loans"),
        ratio_or_null(c("a_moy"), c("a_year")).alias("month_within_year_weight_amount"),
    )


def channel_spine(channels: DataFrame, calendar: DataFrame, today: dt.date, years: int = 5,
                  ahead_biz_days: int = AHEAD_BIZ_DAYS) -> DataFrame:
    """Dense grid of distinct channels and days: every channel unfolds its own days, then
    looks up the (broadcast, day-bounded) calendar."""
    bound = nth_future_bizday_bound(calendar, today, ahead_biz_days).scalar()
    days = F.sequence(F.add_months(F.lit(today), -12 * years), F.col("upper_bound"))
    d = F.col("calendar_date")
    return (
        channels.withColumn("upper_bound", bound)
        .select("channel", F.explode(days).alias("calendar_date"))
        .join(F.broadcast(calendar), "calendar_date")
        .select(
            "calendar_date",
            "channel",
            "biz_day",
            "funding_day",
            "funding_day_remaining_in_month",
            "biz_day_remaining_in_month",
            "is_holiday",
            F.weekday(d).alias("day_of_week"),
            F.dayofmonth(d).alias("day_of_month"),
            week_of_month(d).alias("week_of_month"),
            F.month(d).alias("month_of_year"),
        )
    )


def daily_history(loans: DataFrame, calendar: DataFrame, today: dt.date, years: int = 5,
                  ahead_biz_days: int = AHEAD_BIZ_DAYS) -> DataFrame:
    """Every day and channel of the trailing years, weekends zero.

    Loans are read once: channels and days both come from the written reduction.
    """
    reduced = stage(reduced_loans(loans, calendar, today, years, ahead_biz_days), "loans_by_day")
    weights = calendar_weights(reduced.filter(F.col("funded_date").isNotNull()))
    spine = channel_spine(reduced.select("channel").distinct(), calendar, today, years, ahead_biz_days)
    joined = spine.join(
        weights.withColumnRenamed("funded_date", "calendar_date"),
        ["calendar_date", "channel"],
        "left",
    ).withColumn("total_loan_amount", F.col("total_loan_amount").cast("double"))
    filled = joined.fillna(0, subset=MEASURES + WEIGHT_COLUMNS)
    return weekend_zero(filled, "calendar_date", MEASURES + WEIGHT_COLUMNS).select(
        *spine.columns, *MEASURES, *WEIGHT_COLUMNS
    )


def series_history(daily: DataFrame, target: str = "total_loan_amount") -> DataFrame:
    """The (series, day, amount) view that the fits read."""
    return daily.select(
        F.col("channel").alias("series_id"),
        F.col("calendar_date").alias("day"),
        F.col(target).cast("double").alias("amount"),
    )
