"""Funnel metrics per file date and channel.

A loan that holds a third of all snapshot rows must not multiply: both sides are
reduced to their distinct rows with a row count, and then to one row per loan (and file
date), before they meet. Counts are 64-bit and enter products as decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.predicates import normalized_channel, status_kept
from tidecast.staging import stage

# event kind -> date column of the loan table
EVENT_DATES = {
    "application": "unified_app_date",
    "submission": "underwriting_submission_date",
    "approval": "initial_conditional_approval_date",
}
CALENDAR_COLUMNS = [
    "biz_day",
    "biz_day_remaining_in_month",
    "biz_days_in_month",
    "is_holiday",
    "is_company_holiday",
    "calendar_days_remaining",
]
COUNT_COLUMNS = [
    "underwriting_submission_events",
    "approval_events",
    "application_count",
]
VOLUME_COLUMNS = [
    "underwriting_submission_event_volume",
    "approval_event_volume",
    "application_volume",
]


def _loan_events(loans: DataFrame, *kept: str) -> DataFrame:
    """Unpivot the three event dates, so one pass serves all kinds."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("dt")) for k, c in EVENT_DATES.items()]
    )
    return (
        loans.select("loan_number", "channel", *kept, F.explode(kinds).alias("e"))
        .select("loan_number", "channel", *kept, "e.kind", "e.dt")
        .filter("dt is not null")
    )


def event_groups(loans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Loans and amounts per event day, channel and kind, still to be added up.

    Loans meet their amounts before their events unfold. The events of a loan with one distinct
    row are distinct as they stand and add up by day at once; only those of other loans are
    grouped by the loan (``several``), so a task holds no entry for each event.
    """
    amounts = (
        snapshots.select("loan_number", "loan_amount")
        .distinct()
        .groupBy("loan_number")
        .agg(F.sum("loan_amount").alias("amount"))
    )
    rows = loans.select("loan_number", "channel", *EVENT_DATES.values()).distinct()
    n_rows = F.count("*").over(Window.partitionBy("loan_number"))
    known = rows.join(amounts, "loan_number").withColumn(
        "several", F.when(n_rows > 1, F.col("loan_number"))
    )
    several = F.col("several").isNotNull()
    return (
        _loan_events(known, "several", "amount")
        .groupBy("dt", "channel", "kind", "several")
        .agg(
            F.when(several, 1).otherwise(F.count("*")).alias("n"),
            F.when(several, F.max("amount")).otherwise(F.sum("amount")).alias("amount"),
        )
    )


def event_counts(loans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Distinct loans per event day and channel, and their snapshot volume.

    The volume counts every distinct snapshot amount of a loan once per event row.
    """

    def count(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    def volume(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.col("amount"))).cast("decimal(38,2)")

    return event_groups(loans, snapshots).groupBy("dt", "channel").agg(
        count("application").alias("application_count"),
        volume("application").alias("application_volume"),
        count("submission").alias("underwriting_submission_events"),
        volume("submission").alias("underwriting_submission_event_volume"),
        count("approval").alias("approval_events"),
        volume("approval").alias("approval_event_volume"),
    )


def event_counts_simple(loans: DataFrame) -> DataFrame:
    """Older form: plain row counts of the loan table, no volumes."""
    return (
        _loan_events(loans)
        .groupBy("dt", "channel")
        .agg(
            F.count_if(F.col("kind") == "application").alias("application_count"),
            F.count_if(F.col("kind") == "submission").alias("underwriting_submission_events"),
            F.count_if(F.col("kind") == "approval").alias("approval_events"),
        )
    )


def status_filter(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(status_kept(F.col("loan_status")))


def _copies(rows: DataFrame) -> Column:
    """How many rows of the table a row stands for, as an exact factor."""
    n = F.col("n_rows") if "n_rows" in rows.columns else F.lit(1)
    return n.cast("decimal(19,0)")


def reduced_loans(loans: DataFrame) -> DataFrame:
    """Distinct loan rows, as far as the funnel reads them, with their number."""
    return loans.groupBy(
        "loan_number", "channel", "repeat_application", *EVENT_DATES.values(),
        F.when(F.col("funded_date").isNotNull(), 1).alias("funded_date"),
    ).agg(F.count("*").alias("n_rows"))


def reduced_snapshots(snapshots: DataFrame) -> DataFrame:
    """Distinct snapshots per day with their number; ``kept`` says whether the status counts."""
    kept = F.coalesce(status_kept(F.col("loan_status")), F.lit(False))
    return snapshots.groupBy(
        "loan_number", F.col("filedt").cast("date").alias("filedt"), "channel", "loan_amount",
        kept.alias("kept"),
    ).agg(F.count("*").alias("n_rows"))


def loan_stages(loans: DataFrame) -> DataFrame:
    """One row per loan: how many of its rows exist and have reached each stage."""
    n = _copies(loans)

    def reached(column: str):
        return F.coalesce(F.sum(F.when(F.col(column).isNotNull(), n)), F.lit(0)).cast("long")

    return (
        loans.filter(F.col("repeat_application") == 0)
        .groupBy("loan_number")
        .agg(
            F.sum(n).cast("long").alias("n_rows"),
            reached("funded_date").alias("n_funded"),
            reached("underwriting_submission_date").alias("n_submitted"),
            reached("initial_conditional_approval_date").alias("n_approved"),
        )
    )


def funnel_base(loans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Counts of distinct loans and joined-row volumes per file date and channel.

    Takes raw tables or reduced ones.
    """
    if "kept" in snapshots.columns:
        counted = snapshots.filter("kept")
    else:
        counted = status_filter(snapshots)
    amount = F.col("loan_amount") * _copies(snapshots)
    per_loan_day = counted.groupBy(
        "loan_number", F.col("filedt").cast("date").alias("filedt"), "channel"
    ).agg(F.sum(amount).cast("decimal(28,2)").alias("amount"))
    joined = per_loan_day.join(loan_stages(loans), "loan_number")

    def volume(n: str):
        product = F.col("amount") * F.col(n).cast("decimal(19,0)")
        return F.sum(product.cast("decimal(38,2)")).cast("decimal(38,2)")

    return joined.groupBy("filedt", "channel").agg(
        F.count("*").alias("loan_count"),
        volume("n_rows").alias("loan_volume"),
        F.count_if(F.col("n_funded") > 0).alias("funded_loan_count"),
        volume("n_funded").alias("funded_loan_volume"),
        F.count_if(F.col("n_submitted") > 0).alias("underwriting_submission_count"),
        F.count_if(F.col("n_approved") > 0).alias("initial_conditional_approval_count"),
    )


def pull_through(part: str, whole: str):
    """Percentage with two decimals in exact arithmetic, null for an empty base."""
    pct = F.try_divide(
        100 * F.col(part).cast("decimal(28,2)"), F.col(whole).cast("decimal(28,2)")
    )
    return pct.cast("decimal(10,2)")


def average_size(volume: str, count: str):
    """Mean amount per event with two decimals in exact arithmetic, null without events."""
    mean = F.try_divide(F.col(volume).cast("decimal(28,2)"), F.col(count).cast("decimal(19,0)"))
    return mean.cast("decimal(18,2)")


def with_calendar(per_day: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekday file dates with their calendar columns. A left join that a filter on
    its right side makes inner; the calendar is bounded by its days."""
    cal = calendar.select("calendar_date", "is_weekday", *CALENDAR_COLUMNS)
    return (
        per_day.join(F.broadcast(cal), F.col("filedt") == F.col("calendar_date"), "left")
        .filter("is_weekday = 1")
        .drop("calendar_date", "is_weekday")
    )


def funnel_daily(loans: DataFrame, snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """The whole funnel: 17 metrics per weekday file date and channel.

    Each table is read once and reduced; both halves start from the written reductions.
    """
    loans = stage(reduced_loans(loans), "loans")
    snapshots = stage(reduced_snapshots(snapshots), "snapshots")
    events = event_counts(loans, snapshots).withColumnRenamed("dt", "filedt")
    joined = (
        funnel_base(loans, snapshots)
        .join(events, ["filedt", "channel"], "left")
        .fillna(0, subset=COUNT_COLUMNS + VOLUME_COLUMNS)
    )
    metrics = joined.select(
        "filedt",
        "channel",
        "loan_count",
        "loan_volume",
        "funded_loan_count",
        "funded_loan_volume",
        "underwriting_submission_count",
        "initial_conditional_approval_count",
        "underwriting_submission_events",
        "underwriting_submission_event_volume",
        "approval_events",
        "approval_event_volume",
        "application_count",
        "application_volume",
        pull_through("funded_loan_count", "loan_count").alias("pull_through_pct_count"),
        pull_through("funded_loan_volume", "loan_volume").alias("pull_through_pct_volume"),
        average_size("application_volume", "application_count").alias(
            "avg_application_loan_size"
        ),
        average_size(
            "underwriting_submission_event_volume", "underwriting_submission_events"
        ).alias("avg_underwriting_submission_loan_size"),
        average_size("approval_event_volume", "approval_events").alias("avg_approval_loan_size"),
    )
    return with_calendar(metrics, calendar)


def funnel_daily_simple(loans: DataFrame, snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Older form of the funnel: event row counts, no event volumes or sizes."""
    events = event_counts_simple(loans).withColumnRenamed("dt", "filedt")
    joined = (
        funnel_base(loans, snapshots)
        .join(events, ["filedt", "channel"], "left")
        .fillna(0, subset=COUNT_COLUMNS)
    )
    metrics = joined.withColumns(
        {
            "pull_through_pct_count": pull_through("funded_loan_count", "loan_count"),
            "pull_through_pct_volume": pull_through("funded_loan_volume", "loan_volume"),
        }
    )
    return with_calendar(metrics, calendar)


SUMMED = [
    "loan_count", "loan_volume", "funded_loan_count", "funded_loan_volume",
    "underwriting_submission_count", "initial_conditional_approval_count",
    *COUNT_COLUMNS, *VOLUME_COLUMNS,
]


def funnel_series(funnel: DataFrame) -> DataFrame:
    """Numeric view for indicators and signatures: series key, nulls as 0, doubles.

    Series carry the names of the daily history: channels that normalise to one name are
    added up, and percentages and sizes are taken from the sums.
    """
    columns = [c for c in funnel.columns if c not in ("filedt", "channel")]
    summed = [c for c in SUMMED if c in columns]
    kept = [c for c in CALENDAR_COLUMNS if c in columns]
    rows = funnel.groupBy(normalized_channel(F.col("channel")).alias("series_id"), "filedt").agg(
        *[F.sum(c).alias(c) for c in summed], *[F.max(c).alias(c) for c in kept]
    )
    derived = {
        "pull_through_pct_count": pull_through("funded_loan_count", "loan_count"),
        "pull_through_pct_volume": pull_through("funded_loan_volume", "loan_volume"),
    }
    if "approval_event_volume" in columns:
        derived |= {
            "avg_application_loan_size": average_size("application_volume", "application_count"),
            "avg_underwriting_submission_loan_size": average_size(
                "underwriting_submission_event_volume", "underwriting_submission_events"),
            "avg_approval_loan_size": average_size("approval_event_volume", "approval_events"),
        }
    rows = rows.withColumns({k: v for k, v in derived.items() if k in columns})
    return rows.select("series_id", "filedt", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns
    ])
