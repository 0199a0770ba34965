"""Scans: a query on a warehouse, a parquet table, or an inline table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc_query(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: str | None = None,
    upper_bound: str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Run one SQL text on a warehouse. With a partition column the scan is split
    into ``num_partitions`` range queries, so no single task pulls the whole table."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if driver:
        reader = reader.option("driver", driver)
    if partition_column:
        # the JDBC source wants a table expression, not `query`, for a split scan
        reader = (
            reader.option("dbtable", f"({query}) q")
            .option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", num_partitions)
        )
    else:
        reader = reader.option("query", query)
    return reader.load()


def read_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run one SQL text on given DataFrames."""
    return spark.sql(query, **tables)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


# Tuned monthly parameters and their regime labels. Columns:
# month, regime, recency, trend dampening, daily lift, lookback days,
# trend-seasonal tilt, weekday shrinkage, interaction shrinkage, seasonal
# exponent, actual total. December is absent.
MONTHLY_OPTIMAL_PARAMS = (
    ("2025-01", "January", 0.20, 0.70, 0.000, 60, 0.08, 0.25, 0.20, 1.05, 165761576),
    ("2025-02", "Regime1", 1.00, 0.70, 0.005, 90, 0.15, 0.10, 0.35, 1.05, 175734244),
    ("2025-03", "Regime1", 1.00, 0.70, 0.000, 90, 0.00, 0.10, 0.20, 1.05, 181623181),
    ("2025-04", "Regime1", 1.00, 0.70, 0.005, 90, 0.15, 0.10, 0.20, 1.00, 194492552),
    ("2025-05", "Regime1", 1.00, 0.70, 0.005, 90, 0.08, 0.10, 0.20, 1.00, 174537762),
    ("2025-06", "Regime1", 1.00, 0.70, 0.005, 90, 0.15, 0.10, 0.20, 1.05, 179300643),
    ("2025-07", "Regime1", 1.00, 0.70, 0.005, 90, 0.15, 0.10, 0.50, 1.05, 193088074),
    ("2025-08", "Regime1", 1.00, 0.70, 0.005, 90, 0.15, 0.10, 0.20, 1.05, 199246002),
    ("2025-09", "Transition", 1.00, 0.90, 0.000, 60, 0.00, 0.25, 0.50, 1.00, 228926998),
    ("2025-10", "Regime2", 0.35, 0.83, 0.000, 60, 0.08, 0.05, 0.35, 1.00, 227532649),
    ("2025-11", "Regime2", 0.35, 0.83, 0.000, 60, 0.00, 0.25, 0.35, 1.00, 195281169),
    ("2026-01", "January", 0.20, 0.70, 0.005, 90, 0.00, 0.25, 0.50, 1.05, 186217022),
    ("2026-02", "Regime2", 1.00, 0.83, 0.000, 60, 0.00, 0.25, 0.35, 1.02, 205220387),
    ("2026-03", "Regime2", 1.00, 0.83, 0.000, 60, 0.08, 0.05, 0.20, 1.02, 246341013),
)
# Numeric code of a regime label.
REGIME_CODES = {"January": 0.0, "Regime1": 1.0, "Transition": 1.5, "Regime2": 2.0}

_INLINE_SCHEMA = (
    "period string, regime string, recency_strength double, trend_dampening double, "
    "forward_lift_daily double, level_lookback_days int, trend_seasonal_tilt double, "
    "dow_shrinkage double, interaction_shrinkage double, seasonal_exponent double, "
    "actual_total long"
)


def monthly_optimal_params(spark: SparkSession, month_shift: int = 0) -> DataFrame:
    """The inline table with its regime code and the change of the actual total.

    ``month_shift`` moves the labels in time, to line them up with other data.
    """
    from pyspark.sql import Window

    codes = F.create_map(*[F.lit(x) for kv in REGIME_CODES.items() for x in kv])
    rows = spark.createDataFrame(MONTHLY_OPTIMAL_PARAMS, _INLINE_SCHEMA)
    by_month = Window.orderBy("month")  # fourteen literal rows
    return (
        rows.withColumn(
            "month",
            F.add_months(F.to_date(F.concat("period", F.lit("-01"))), month_shift),
        )
        .withColumn("period", F.date_format("month", "yyyy-MM"))
        .withColumn("regime_numeric", codes[F.col("regime")])
        .withColumn(
            "actual_total_growth",
            F.col("actual_total") / F.lag("actual_total").over(by_month) - 1,
        )
    )
