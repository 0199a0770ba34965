"""Bind the star-schema test tables to loans, snapshots and a calendar.

Orders stand in for loans and for their dated snapshots; the ship dates of an
order's lines stand in for its submission and approval dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import nth_weekday_of_month
from tidecast.operators.calendar import calendar_dimension
from tidecast.sources.readers import read_table

# The daily history is cut as of AS_OF; forecasts pretend to run on TODAY.
AS_OF = dt.date(2001, 7, 27)
TODAY = dt.date(2001, 3, 30)
TRAIN_START = dt.date(1996, 9, 1)
# Run dates whose horizons cover a December, a January and a spring month.
RUN_TODAYS = (dt.date(2000, 11, 20), dt.date(2000, 12, 28), TODAY)
# Months whose tuned parameters serve as the anchor table.
ANCHOR_MONTHS = (dt.date(1999, 3, 1), dt.date(2001, 3, 1))
# The study's and the backtest's fixed dates, moved onto the test data.
MONTH_SHIFT = -300

CHANNEL_BY_PRIORITY = {
    "1": "Wholesale",
    "2": "Retail",
    "3": "Retail Broker",
    "4": "National Corr",
    "5": "Credit Union Partners",
}


def _channel(priority: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CHANNEL_BY_PRIORITY.items() for x in kv])
    return names[F.substring(priority, 1, 1)]


def loans(spark: SparkSession, directory: str, event_dates: bool = True) -> DataFrame:
    """One row per order. Without ``event_dates`` the line items are not read."""
    order_day = F.to_date("o_orderdate")
    base = read_table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("loan_number"),
        _channel(F.col("o_orderpriority")).alias("channel"),
        F.when(F.col("o_orderstatus") != "P", order_day).alias("funded_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("loan_amount"),
        F.date_sub(order_day, 30).alias("unified_app_date"),
        (F.col("o_custkey") % 10 == 0).cast("int").alias("repeat_application"),
    )
    if not event_dates:
        return base
    shipped = (
        read_table(spark, directory, "lineitem")
        .groupBy(F.col("l_orderkey").alias("loan_number"))
        .agg(
            F.to_date(F.min("l_shipdate")).alias("underwriting_submission_date"),
            F.to_date(F.max("l_shipdate")).alias("initial_conditional_approval_date"),
        )
    )
    return base.join(shipped, "loan_number", "left")


def funded_loans(spark: SparkSession, directory: str, since: dt.date,
                 until: dt.date) -> DataFrame:
    """Loans funded in [since, until]; the filters name raw columns and reach the scan."""
    order_day = F.to_date("o_orderdate")
    return (
        read_table(spark, directory, "orders")
        .filter((F.col("o_orderstatus") != "P") & order_day.between(F.lit(since), F.lit(until)))
        .select(
            _channel(F.col("o_orderpriority")).alias("channel"),
            order_day.alias("funded_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("loan_amount"),
        )
    )


def snapshots(spark: SparkSession, directory: str) -> DataFrame:
    code = F.lpad((F.col("o_custkey") % 2000).cast("string"), 4, "0")
    with_letter = F.concat(F.substring(code, 1, 2), F.lit("c4"))
    return read_table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("loan_number"),
        F.to_date("o_orderdate").alias("filedt"),
        _channel(F.col("o_orderpriority")).alias("channel"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("loan_amount"),
        F.when(F.col("o_custkey") % 37 == 0, with_letter).otherwise(code).alias("loan_status"),
    )


def company_holidays(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """The Friday after the fourth Thursday of November."""
    years = spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("y"))
    thursday = nth_weekday_of_month(F.col("y"), F.lit(11), F.lit(4), F.lit(3))
    return years.select(F.date_add(thursday, 1).alias("calendar_date"))


def calendar_range(spark: SparkSession, directory: str) -> tuple[dt.date, dt.date]:
    """Whole years from one before the first file date to one after the last."""
    first, last = (
        read_table(spark, directory, "orders")
        .agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate")))
        .first()
    )
    if first is None:
        raise ValueError("orders holds no dates to span a calendar")
    return dt.date(first.year - 1, 1, 1), dt.date(last.year + 1, 12, 31)


def calendar(spark: SparkSession, directory: str) -> DataFrame:
    start, end = calendar_range(spark, directory)
    return calendar_dimension(spark, start, end, company_holidays(spark, start, end))


__all__ = [
    "ANCHOR_MONTHS", "AS_OF", "MONTH_SHIFT", "RUN_TODAYS", "TODAY", "TRAIN_START",
    "calendar", "calendar_range", "company_holidays", "funded_loans", "loans", "snapshots",
]
