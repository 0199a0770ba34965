"""Fixed schemas of the tables that cross an operator boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


LOANS = _struct(
    ("loan_number", T.LongType()),
    ("channel", T.StringType()),
    ("funded_date", T.DateType()),
    ("loan_amount", MONEY),
    ("unified_app_date", T.DateType()),
    ("underwriting_submission_date", T.DateType()),
    ("initial_conditional_approval_date", T.DateType()),
    ("repeat_application", T.IntegerType()),
)

SNAPSHOTS = _struct(
    ("loan_number", T.LongType()),
    ("filedt", T.DateType()),
    ("channel", T.StringType()),
    ("loan_amount", MONEY),
    ("loan_status", T.StringType()),
)

CALENDAR = _struct(
    ("calendar_date", T.DateType()),
    ("is_weekday", T.IntegerType()),
    ("is_holiday", T.IntegerType()),
    ("is_company_holiday", T.IntegerType()),
    ("biz_day", T.IntegerType()),
    ("funding_day", T.IntegerType()),
    ("biz_days_in_month", T.IntegerType()),
    ("biz_day_remaining_in_month", T.IntegerType()),
    ("funding_day_remaining_in_month", T.IntegerType()),
    ("calendar_days_remaining", T.IntegerType()),
)

# Dense series that every fit reads: one row per series and calendar day.
HISTORY = _struct(
    ("series_id", T.StringType()),
    ("day", T.DateType()),
    ("amount", T.DoubleType()),
)

# The eight model parameters, in grid order (the last one varies fastest).
PARAM_NAMES = (
    "recency_strength",
    "dow_shrinkage",
    "interaction_shrinkage",
    "seasonal_exponent",
    "trend_dampening",
    "forward_lift_daily",
    "level_lookback_days",
    "trend_seasonal_tilt",
)
PARAM_TYPES = {p: "int" if p == "level_lookback_days" else "double" for p in PARAM_NAMES}

RUNS = _struct(
    ("run_id", T.StringType()),
    ("series_id", T.StringType()),
    ("today", T.DateType()),
    ("train_start", T.DateType()),
    ("known_through", T.DateType()),
    ("forecast_start", T.DateType()),
    ("forecast_end", T.DateType()),
    ("output_through", T.DateType()),
)

REGISTRY = _struct(
    ("label", T.StringType()),
    ("channel", T.StringType()),
    ("window_start", T.DateType()),
    ("window_end", T.DateType()),
    ("prior_start", T.DateType()),
    ("prior_end", T.DateType()),
    ("january_only", T.BooleanType()),
    ("high_error_flag", T.BooleanType()),
    ("run_date", T.DateType()),
    ("abs_err", T.DecimalType(6, 4)),
    ("signed_err", T.DecimalType(6, 4)),
    ("actual_total", T.LongType()),
    ("forecast_total", T.LongType()),
    ("actual_biz_days", T.IntegerType()),
    ("recency_strength", T.DecimalType(4, 2)),
    ("dow_shrinkage", T.DecimalType(4, 2)),
    ("interaction_shrinkage", T.DecimalType(4, 2)),
    ("seasonal_exponent", T.DecimalType(5, 3)),
    ("trend_dampening", T.DecimalType(4, 2)),
    ("forward_lift_daily", T.DecimalType(6, 4)),
    ("level_lookback_days", T.IntegerType()),
    ("trend_seasonal_tilt", T.DecimalType(4, 2)),
)


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema``, failing early on a missing one or another type."""
    have = {f.name: f.dataType for f in df.schema}
    for field in schema:
        if field.name not in have:
            raise ValueError(f"missing column {field.name}")
        if have[field.name] != field.dataType:
            raise ValueError(f"column {field.name}: {have[field.name]} is not {field.dataType}")
    return df.select(*schema.fieldNames())
