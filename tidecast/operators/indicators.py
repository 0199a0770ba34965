"""Monthly leading indicators of a funnel and their growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidecast.functions.dates import business_day_add, month_start
from tidecast.functions.numeric import pct_change, ratio_or_null

EVENT_SUMS = ["application_count", "approval_events", "underwriting_submission_events"]
WIDE_SUMS = [
    "loan_count",
    "loan_volume",
    "funded_loan_count",
    "funded_loan_volume",
    "underwriting_submission_count",
    "initial_conditional_approval_count",
    "underwriting_submission_events",
    "approval_events",
    "application_count",
]
CALENDAR_INDICATORS = [
    "biz_days_in_month",
    "holiday_count",
    "company_holiday_count",
    "effective_biz_days",
    "biz_day_coverage_pct",
]
INDICATORS = (
    WIDE_SUMS
    + ["pull_through_pct_count", "pull_through_pct_volume"]
    + CALENDAR_INDICATORS
    + [f"{c}_per_bizday" for c in WIDE_SUMS]
)


# growth of the partial month -> its indicator and how many months back
MTD_GROWTH = {
    "application_count_per_bizday_growth_1m": ("application_count_per_bizday", 1),
    "application_count_per_bizday_growth_3m": ("application_count_per_bizday", 3),
    "approval_events_per_bizday_growth_1m": ("approval_events_per_bizday", 1),
    "underwriting_submission_events_per_bizday_growth_1m": (
        "underwriting_submission_events_per_bizday", 1),
}
SMOOTHED = ("application_count_per_bizday_growth_1m", "approval_events_per_bizday_growth_1m")


def by_month() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("month")


def month_sums(funnel: DataFrame, cols: list[str], *extra: Column) -> DataFrame:
    return funnel.groupBy("series_id", month_start(F.col("filedt")).alias("month")).agg(
        *[F.sum(c).alias(c) for c in cols], *extra
    )


def pull_through_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns(
        {
            "pull_through_pct_count": ratio_or_null(
                100.0 * F.col("funded_loan_count"), F.col("loan_count")
            ),
            "pull_through_pct_volume": ratio_or_null(
                100.0 * F.col("funded_loan_volume"), F.col("loan_volume")
            ),
        }
    )


def calendar_aggregates() -> list[Column]:
    return [
        F.max("biz_days_in_month").alias("biz_days_in_month"),
        F.sum("biz_day").alias("biz_days_with_data"),
        F.sum("is_holiday").alias("holiday_count"),
        F.sum("is_company_holiday").alias("company_holiday_count"),
        F.min("biz_day_remaining_in_month").alias("min_biz_remaining"),
        F.min("calendar_days_remaining").alias("min_cal_remaining"),
    ]


def _per_bizday(monthly: DataFrame, cols: list[str]) -> DataFrame:
    return monthly.withColumns(
        {f"{c}_per_bizday": ratio_or_null(F.col(c), F.col("effective_biz_days")) for c in cols}
    )


def _growth(col: str, k: int) -> Column:
    return pct_change(F.col(col), F.lag(col, k).over(by_month()))


def _effective_from_calendar() -> Column:
    return (
        F.col("biz_days_in_month") - F.col("holiday_count") - F.col("company_holiday_count")
    )


def monthly_indicators_mtd(funnel: DataFrame, today: Column | None = None) -> DataFrame:
    """Months up to the weekday before ``today``, the current one still partial.

    Business days are counted from the rows present, so a partial month is scaled
    by the days it really has.
    """
    rows = funnel
    if today is not None:
        rows = funnel.filter(F.col("filedt") <= business_day_add(today, -1))
    monthly = month_sums(
        rows,
        EVENT_SUMS,
        F.greatest(F.count_if(_worked()), F.lit(1)).cast("double").alias("effective_biz_days"),
    )
    out = _per_bizday(monthly, EVENT_SUMS)
    return out.withColumns({name: _growth(c, k) for name, (c, k) in MTD_GROWTH.items()})


def _worked() -> Column:
    return (
        (F.weekday("filedt") < 5)
        & (F.col("is_holiday") != 1)
        & (F.col("is_company_holiday") != 1)
    )


def indicators_by_day(funnel: DataFrame, smooth: bool = True) -> DataFrame:
    """The last month of ``monthly_indicators_mtd`` as of every file date of every series.

    Running sums within each month give the partial month, and its growth is against whole earlier
    months, which any later date sees alike. So one table, a row per series and file date,
    answers every run. ``smooth`` as in ``smooth_growth``.
    """
    so_far = Window.partitionBy("series_id", "month").orderBy("filedt")
    worked = F.sum(F.when(_worked(), 1).otherwise(0)).over(so_far)
    dated = funnel.withColumn("month", month_start(F.col("filedt"))).select(
        "series_id", "filedt", "month", *[F.sum(c).over(so_far).alias(c) for c in EVENT_SUMS],
        F.greatest(worked, F.lit(1)).cast("double").alias("effective_biz_days"),
    )
    earlier = {
        f"{c}_{k}_ago": F.lag(c, k).over(by_month()) for c, k in MTD_GROWTH.values()
    } | {f"{g}_before": F.lag(g, 1).over(by_month()) for g in SMOOTHED}
    monthly = monthly_indicators_mtd(funnel).select(
        "series_id", "month", *[c.alias(n) for n, c in earlier.items()]
    )
    out = _per_bizday(dated, EVENT_SUMS).join(monthly, ["series_id", "month"])
    grown = {n: pct_change(F.col(c), F.col(f"{c}_{k}_ago")) for n, (c, k) in MTD_GROWTH.items()}
    out = out.withColumns(grown)
    if smooth:  # adding null gives null, as a mean of fewer than two does
        out = out.withColumns({g: (F.col(g) + F.col(f"{g}_before")) / 2 for g in SMOOTHED})
    return out.drop(*earlier)


def monthly_indicators_full(funnel: DataFrame) -> DataFrame:
    """Whole months; business days come from the calendar columns."""
    monthly = month_sums(
        funnel,
        EVENT_SUMS,
        F.max("biz_days_in_month").alias("biz_days_in_month"),
        F.sum("is_holiday").alias("holiday_count"),
        F.sum("is_company_holiday").alias("company_holiday_count"),
    ).withColumn("effective_biz_days", _effective_from_calendar())
    out = _per_bizday(monthly, EVENT_SUMS)
    return out.withColumns(
        {
            "approval_events_per_bizday_growth_1m": _growth("approval_events_per_bizday", 1),
            "underwriting_submission_events_per_bizday_growth_1m": _growth(
                "underwriting_submission_events_per_bizday", 1
            ),
        }
    )


def monthly_indicators_wide(funnel: DataFrame) -> DataFrame:
    """All 25 indicators per series and month."""
    monthly = pull_through_monthly(month_sums(funnel, WIDE_SUMS, *calendar_aggregates()))
    monthly = monthly.withColumns(
        {
            "biz_day_coverage_pct": ratio_or_null(
                F.col("biz_days_with_data"), F.col("biz_days_in_month")
            ),
            "effective_biz_days": _effective_from_calendar(),
        }
    )
    return _per_bizday(monthly, WIDE_SUMS)


def growth_ladder(monthly: DataFrame, indicators: list[str] = INDICATORS,
                  steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Long table (series, month, indicator, value) of levels and 1..3-month growth.

    One unpivot and one window per (series, indicator) replace a column per growth.
    """
    levels = monthly.unpivot(["series_id", "month"], [
        F.col(c).cast("double").alias(c) for c in indicators
    ], "indicator", "level")
    w = Window.partitionBy("series_id", "indicator").orderBy("month")
    grown = levels.withColumns(
        {f"growth_{k}m": pct_change(F.col("level"), F.lag("level", k).over(w)) for k in steps}
    )
    entries = [F.struct(F.col("indicator").alias("indicator"), F.col("level").alias("value"))] + [
        F.struct(
            F.concat("indicator", F.lit(f"_growth_{k}m")).alias("indicator"),
            F.col(f"growth_{k}m").alias("value"),
        )
        for k in steps
    ]
    return grown.select("series_id", "month", F.explode(F.array(*entries)).alias("e")).select(
        "series_id", "month", "e.indicator", "e.value"
    )


def smooth_growth(monthly: DataFrame, cols: tuple[str, ...] = SMOOTHED) -> DataFrame:
    """Mean of this and the previous row; null until both exist."""
    two = by_month().rowsBetween(-1, 0)
    return monthly.withColumns(
        {c: F.when(F.count(c).over(two) == 2, F.avg(c).over(two)) for c in cols}
    )


def latest_month(monthly: DataFrame) -> DataFrame:
    """The last row of every series."""
    row = F.struct(*[F.col(c) for c in monthly.columns if c != "series_id"])
    return (
        monthly.groupBy("series_id").agg(F.max_by(row, "month").alias("r"))
        .select("series_id", "r.*")
    )
