"""Indicator study: which leading indicators move with the best parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tuned quantities, the leads in months, the indicators of the score
# and the words that mark calendar indicators.
TARGETS = [
    "regime_numeric",
    "trend_dampening",
    "forward_lift_daily",
    "level_lookback_days",
    "recency_strength",
    "trend_seasonal_tilt",
    "seasonal_exponent",
    "dow_shrinkage",
    "interaction_shrinkage",
]
LEADS = (0, 1, 2, 3)
KEY_INDICATORS = [
    "application_count_per_bizday",
    "approval_events_per_bizday_growth_1m",
    "underwriting_submission_events_per_bizday_growth_1m",
]
CALENDAR_WORDS = ["biz_day", "holiday", "effective", "calendar", "per_bizday"]


def pearson(x: str, y: str) -> Column:
    """Correlation that is null, not an error, where a side has no variance."""
    return F.try_divide(F.covar_samp(x, y), F.stddev(x) * F.stddev(y))


def lead_lag_join(params: DataFrame, indicators: DataFrame,
                  leads: tuple[int, ...] = LEADS) -> DataFrame:
    """Parameters of a month with the indicators of the month ``lead`` months before.

    ``indicators`` carries its own month as ``month``; each row unfolds into one row
    per lead and meets the (small, literal) parameters by month.
    """
    shifted = (
        indicators.withColumnRenamed("month", "indicator_month")
        .withColumn("lead", F.explode(F.array(*[F.lit(k) for k in leads])))
        .withColumn("month", F.add_months("indicator_month", F.col("lead")))
    )
    return shifted.join(params, "month")


def correlation_sweep(params: DataFrame, ladder: DataFrame, min_obs: int = 4) -> DataFrame:
    """Pearson correlation of every (lead, indicator, target).

    The targets unfold per joined row, so all correlations are one aggregation.
    Pairs with a missing value drop; constant columns give no correlation. Results have three
    digits, halves to even.
    """
    joined = lead_lag_join(params, ladder.filter(F.col("value").isNotNull()))
    targets = F.array(
        *[F.struct(F.lit(t).alias("param"), F.col(t).cast("double").alias("target"))
          for t in TARGETS]
    )
    return (
        joined.select("series_id", "lead", "indicator", "value", F.explode(targets).alias("t"))
        .select("series_id", "lead", "indicator", "value", "t.param", "t.target")
        .groupBy("series_id", "lead", "indicator", "param")
        .agg(
            F.count("*").alias("n_obs"),
            pearson("value", "target").alias("r"),
            F.stddev("value").alias("sd_value"),
            F.stddev("target").alias("sd_target"),
        )
        .filter(
            (F.col("n_obs") >= min_obs) & (F.col("sd_value") > 0) & (F.col("sd_target") > 0)
            & F.col("r").isNotNull() & ~F.isnan("r")
        )
        .select(
            "series_id", "lead", "indicator", "param",
            F.bround(F.round("r", 12), 3).alias("correlation"),
            F.bround(F.round(F.abs("r"), 12), 3).alias("abs_corr"),
            "n_obs",
        )
    )


def top_correlations(corr: DataFrame, k: int = 50) -> DataFrame:
    """The k strongest correlations of all (a global top-k, no full sort)."""
    return corr.orderBy(
        F.col("abs_corr").desc(), "series_id", "lead", "indicator", "param"
    ).limit(k)


def best_per_param(corr: DataFrame) -> DataFrame:
    """Strongest indicator of every target."""
    row = F.struct("indicator", "lead", "correlation", "abs_corr", "n_obs")
    order = F.struct(-F.col("abs_corr"), F.col("lead"), F.col("indicator"))
    return (
        corr.groupBy("series_id", "param").agg(F.min_by(row, order).alias("b"))
        .select("series_id", "param", "b.*")
    )


def regime_correlations(corr: DataFrame) -> DataFrame:
    return corr.filter(F.col("param") == "regime_numeric")


def calendar_subset(corr: DataFrame) -> DataFrame:
    """Regime correlations of calendar and per-business-day indicators."""
    hit = F.lit(False)
    for word in CALENDAR_WORDS:
        hit = hit | F.col("indicator").contains(word)
    return regime_correlations(corr).filter(hit)


def per_bizday_subset(corr: DataFrame, k: int = 15) -> DataFrame:
    return _top_per_series(
        regime_correlations(corr).filter(F.col("indicator").contains("per_bizday")), k
    )


def regime_top(corr: DataFrame, k: int = 25) -> DataFrame:
    return _top_per_series(regime_correlations(corr), k)


def _top_per_series(corr: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy(F.col("abs_corr").desc(), "lead", "indicator")
    return corr.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_distinct(corr: DataFrame, k: int = 6) -> DataFrame:
    """Strongest regime correlations after dropping repeats of an indicator."""
    best = Window.partitionBy("series_id", "indicator").orderBy(
        F.col("abs_corr").desc(), "lead"
    )
    once = (
        regime_correlations(corr)
        .withColumn("rn", F.row_number().over(best))
        .filter("rn = 1")
        .drop("rn")
    )
    return _top_per_series(once, k)


def correlation_pivot(corr: DataFrame, k: int = 25,
                      leads: tuple[int, ...] = LEADS) -> DataFrame:
    """Indicator x lead matrix of regime correlations, strongest rows first."""
    wide = (
        regime_correlations(corr)
        .groupBy("series_id", "indicator")
        .pivot("lead", list(leads))
        .agg(F.avg("correlation"))
    )
    for lead in leads:
        wide = wide.withColumnRenamed(str(lead), f"lead_{lead}m")
    strength = F.greatest(*[F.abs(f"lead_{lead}m") for lead in leads])
    w = Window.partitionBy("series_id").orderBy(F.col("max_abs").desc(), "indicator")
    return (
        wide.withColumn("max_abs", strength)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def lead_one(params: DataFrame, monthly: DataFrame) -> DataFrame:
    """Parameters with the key indicators of the month before."""
    return lead_lag_join(
        params.select("month", "period", "regime", "regime_numeric", "actual_total"),
        monthly.select("series_id", "month", *KEY_INDICATORS),
        (1,),
    )


def regime_stats(merged: DataFrame) -> DataFrame:
    """Mean, median, minimum, maximum and count of each key indicator per regime."""
    return (
        merged.unpivot(["series_id", "regime"], KEY_INDICATORS, "indicator", "value")
        .groupBy("series_id", "regime", "indicator")
        .agg(
            F.avg("value").alias("mean"),
            F.median("value").alias("median"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count("value").alias("n"),
        )
    )


def composite_zscore(merged: DataFrame) -> DataFrame:
    """Mean of the z-scores of the key indicators over a series' months; missing
    scores drop out of the mean."""
    w = Window.partitionBy("series_id")

    def z(name: str) -> Column:
        sd = F.stddev(name).over(w)
        return F.when(sd > 0, (F.col(name) - F.avg(name).over(w)) / sd).otherwise(F.lit(0.0))

    scored = merged.withColumns({f"z{i}": z(n) for i, n in enumerate(KEY_INDICATORS)})
    zs = [F.col(f"z{i}") for i in range(len(KEY_INDICATORS))]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in zs), F.lit(0.0))
    count = sum((x.isNotNull().cast("int") for x in zs), F.lit(0))
    return scored.withColumn("composite_score", F.try_divide(total, count.cast("double"))).drop(
        *[f"z{i}" for i in range(len(KEY_INDICATORS))]
    )


def composite_correlation(scored: DataFrame) -> DataFrame:
    return scored.groupBy("series_id").agg(
        pearson("composite_score", "regime_numeric").alias("r"), F.count("*").alias("n")
    )


def threshold_scan(scored: DataFrame) -> DataFrame:
    """Accuracy of every threshold from -1.5 in steps of 0.1. January is left out and
    Transition counts as Regime2."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (i - 15) / 10)
    rows = (
        scored.filter(F.col("regime") != "January")
        .withColumn("is_regime2", F.col("regime").isin("Regime2", "Transition"))
        .withColumn("threshold", F.explode(grid))
    )
    hit = (F.coalesce(F.col("composite_score") >= F.col("threshold"), F.lit(False))
           == F.col("is_regime2"))
    return rows.groupBy("series_id", "threshold").agg(
        F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(hit).alias("correct"),
        F.count("*").alias("total"),
    )


def best_threshold(scan: DataFrame) -> DataFrame:
    """Best accuracy per series; the largest threshold wins ties."""
    return (
        scan.groupBy("series_id")
        .agg(F.max_by(F.struct("threshold", "accuracy"),
                      F.struct("correct", "threshold")).alias("b"))
        .select("series_id", "b.*")
    )


def classification_table(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predicted against actual regime of every month at its series' threshold."""
    predicted = (
        F.when(F.col("regime") == "January", F.lit("January"))
        .when(F.col("composite_score") >= F.col("threshold"), F.lit("Regime2"))
        .otherwise(F.lit("Regime1"))
    )
    return (
        scored.join(thresholds.select("series_id", "threshold"), "series_id")
        .withColumn("predicted_regime", predicted)
        .withColumn("match", F.col("predicted_regime") == F.col("regime"))
    )


def accuracy(classified: DataFrame) -> DataFrame:
    return classified.groupBy("series_id").agg(
        F.count_if("match").alias("correct"),
        F.count("*").alias("total"),
        F.avg(F.col("match").cast("double")).alias("accuracy"),
    )
