"""The registered queries: a Spark job, its columns and the same in plain SQL.

Columns are written ``name`` (as is), ``name:i`` (long), ``name:d`` (date) or
``name:2`` (double rounded to that many digits); both sides get the same shape.
Before rounding, both sides add a thousandth of the last digit or so, far more
than floating-point noise: exact halves (cents over 8 or 16 days are common) then
round the same way whatever an engine's tie rule.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast import oracle as o
from tidecast.functions import dates as fd
from tidecast.functions import numeric as fn
from tidecast.functions import predicates as fp
from tidecast.operators import analog as an
from tidecast.operators import calendar as cal_ops
from tidecast.operators import daily as daily_ops
from tidecast.operators import evaluate as ev
from tidecast.operators import forecast as fo
from tidecast.operators import funnel as fu
from tidecast.operators import indicators as ind
from tidecast.operators import regime as rg
from tidecast.operators import registry as reg
from tidecast.operators import structural as st
from tidecast.operators import study as sy
from tidecast.operators import sweep as sw
from tidecast.plans import analog_forecast as af
from tidecast.plans import backtest as bt
from tidecast.plans import switch as swi
from tidecast.operators.selection import exact_median
from tidecast.schemas import PARAM_NAMES
from tidecast.sources import binding as b
from tidecast.sources import readers, sinks
from tidecast.staging import in_parallel, join_salted, stage, staging_root

UNTIL = dt.date.fromisoformat(o.UNTIL)


class Inputs:
    """The bound tables of one test directory, built on first use."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    @cached_property
    def calendar(self) -> DataFrame:
        return stage(b.calendar(self.spark, self.directory), "calendar")

    @cached_property
    def loans(self) -> DataFrame:
        return b.loans(self.spark, self.directory)

    @cached_property
    def orders_as_loans(self) -> DataFrame:
        return b.loans(self.spark, self.directory, event_dates=False)

    @cached_property
    def funded(self) -> DataFrame:
        since = dt.date(b.AS_OF.year - 5, b.AS_OF.month, b.AS_OF.day)
        until = cal_ops.nth_future_bizday_bound(
            self.calendar, b.AS_OF, daily_ops.AHEAD_BIZ_DAYS).first()["upper_bound"]
        return b.funded_loans(self.spark, self.directory, since, until)

    @cached_property
    def snapshots(self) -> DataFrame:
        return b.snapshots(self.spark, self.directory)

    @cached_property
    def per_day(self) -> DataFrame:
        return daily_ops.funded_per_day(self.funded, self.calendar, b.AS_OF)

    @cached_property
    def daily(self) -> DataFrame:
        return daily_ops.daily_history(self.orders_as_loans, self.calendar, b.AS_OF)

    @cached_property
    def history(self) -> DataFrame:
        return stage(daily_ops.series_history(self.daily), "history")

    @cached_property
    def series(self) -> DataFrame:
        return self.history.select("series_id").distinct()

    @cached_property
    def runs(self) -> DataFrame:
        days = F.explode(F.array(*[F.lit(d) for d in b.RUN_TODAYS]))
        runs = cal_ops.run_windows(self.series.withColumn("today", days), b.TRAIN_START)
        return stage(runs.withColumn("train_end", F.col("known_through")), "runs")

    @cached_property
    def funnel_daily(self) -> DataFrame:
        return fu.funnel_daily(self.loans, self.snapshots, self.calendar)

    @cached_property
    def funnel(self) -> DataFrame:
        return stage(fu.funnel_series(self.funnel_daily), "funnel")

    @cached_property
    def mtd(self) -> DataFrame:
        return ind.monthly_indicators_mtd(fu.funnel_series(self.funnel_daily), F.lit(b.TODAY))

    @cached_property
    def ladder(self) -> DataFrame:
        return ind.growth_ladder(
            ind.monthly_indicators_wide(fu.funnel_series(self.funnel_daily))
        )

    @cached_property
    def optimal(self) -> DataFrame:
        return readers.monthly_optimal_params(self.spark, b.MONTH_SHIFT)

    @cached_property
    def correlations(self) -> DataFrame:
        return sy.correlation_sweep(self.optimal, self.ladder)

    @cached_property
    def lead_one(self) -> DataFrame:
        full = ind.monthly_indicators_full(fu.funnel_series(self.funnel_daily))
        return sy.lead_one(self.optimal, full)

    @cached_property
    def scored(self) -> DataFrame:
        return sy.composite_zscore(self.lead_one)

    @cached_property
    def index(self) -> af.AnalogIndex:
        return af.build_index(self.funnel, self.history, UNTIL)

    def train(self, spec: st.ModelSpec) -> DataFrame:
        return st.training_rows(self.history, self.runs, self.calendar, spec)

    def fit(self, spec: st.ModelSpec) -> st.Fit:
        return st.fit_model(
            self.history, self.runs, st.default_fits(self.runs, spec), self.calendar, spec
        )

    def steps(self, spec: st.ModelSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Staged training rows, parameters and effects."""
        fits = stage(st.with_step_keys(st.default_fits(self.runs, spec)), "fits")
        train = stage(self.train(spec), "train")
        return train, fits, stage(st.fit_effects(train, fits, spec), "effects")

    def forecast(self, spec: st.ModelSpec) -> DataFrame:
        return fo.forecast(self.fit(spec), fo.horizon_requests(self.runs, 2), self.calendar)

    def labelled(self, spec: st.ModelSpec) -> DataFrame:
        return self.forecast(spec).select(
            "run_id", "day", "forecast", F.lit(spec.name).alias("model_used")
        )

    @cached_property
    def month_windows(self) -> DataFrame:
        return sw.monthly_windows(self.series, *b.ANCHOR_MONTHS, b.TRAIN_START)

    @cached_property
    def month_best(self) -> DataFrame:
        return sw.param_sweep(
            self.history, self.month_windows, sw.MONTHLY_GRID, self.calendar, st.MODEL_A
        )

    @cached_property
    def anchors(self) -> DataFrame:
        return stage(
            sw.anchors_from_sweep(self.month_best, self.month_windows, b.TODAY), "anchors"
        )

    def prepare(self) -> None:
        """Index, anchors and runs side by side; all of them read the calendar and the history."""
        _ = self.calendar, self.history
        in_parallel(self.spark, lambda: self.index, lambda: self.anchors, lambda: self.runs)

    def backtest(self) -> DataFrame:
        self.prepare()
        runs = stage(bt.backtest_runs(self.series, b.TRAIN_START, b.MONTH_SHIFT), "runs")
        return bt.batch_backtest(
            self.history, self.index, runs, self.calendar, b.TRAIN_START, n_trials=o.TRIALS,
            anchors=self.anchors,
        )


def nudge(digits: str) -> float:
    return float(f"1.3e-{int(digits) + 3}")


@dataclass(frozen=True)
class Query:
    columns: str
    job: Callable[[Inputs], DataFrame]
    sql: str | None

    def shape(self) -> list[tuple[str, str]]:
        out = []
        for item in self.columns.split():
            name, _, form = item.partition(":")
            out.append((name, form))
        return out

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        df = self.job(Inputs(spark, directory))
        cols = []
        for name, form in self.shape():
            c = F.col(name)
            if form == "i":
                c = c.cast("long")
            elif form == "d":
                c = c.cast("date")
            elif form:
                # adding 0 turns a negative zero into zero
                c = F.round(c.cast("double") + F.lit(nudge(form)), int(form)) + F.lit(0.0)
            cols.append(c.alias(name))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, form in self.shape():
            if form == "i":
                cols.append(f"CAST({name} AS BIGINT) AS {name}")
            elif form == "d":
                cols.append(f"CAST({name} AS DATE) AS {name}")
            elif form:
                cols.append(f"round(CAST({name} AS DOUBLE) + {nudge(form)!r}::DOUBLE, {form})"
                            f" + 0.0 AS {name}")
            else:
                cols.append(name)
        return o.compose(f"SELECT {', '.join(cols)} FROM ({self.sql}) z")


QUERIES: dict[str, Query] = {}


def query(key: str, columns: str, sql: str | None):
    def keep(job: Callable[[Inputs], DataFrame]):
        QUERIES[key] = Query(columns, job, sql)
        return job
    return keep


def plain(key: str, columns: str, sql: str | None, job: Callable[[Inputs], DataFrame]) -> None:
    QUERIES[key] = Query(columns, job, sql)


AS_OF_SQL = f"DATE '{b.AS_OF}'"
TODAY_SQL = f"DATE '{b.TODAY}'"

# ------------------------------------------------------------ scans and sinks

WAREHOUSE_QUERY = """
SELECT channel, year(funded_date) AS funded_year, count(*) AS n, sum(loan_amount) AS amount
FROM {loans} WHERE funded_date IS NOT NULL GROUP BY channel, year(funded_date)"""
plain(
    "src_jdbc_query", "channel funded_year:i n:i amount:2",
    WAREHOUSE_QUERY.format(loans="loans"),
    lambda x: readers.read_sql(x.spark, WAREHOUSE_QUERY, {"loans": x.orders_as_loans}),
)
plain(
    "src_anchor_table",
    "label channel window_start window_end january_only abs_err:4 recency_strength:4 "
    "dow_shrinkage:4 interaction_shrinkage:4 seasonal_exponent:4 trend_dampening:4 "
    "forward_lift_daily:4 level_lookback_days:i trend_seasonal_tilt:4",
    "SELECT * FROM anchors",
    lambda x: x.anchors,
)
plain(
    "src_inline_table",
    "series_id period regime regime_numeric:2 level_lookback_days:i actual_total_growth:8 amount:2",
    """SELECT h.series_id, p.period, p.regime, p.regime_numeric, p.level_lookback_days,
         p.actual_total_growth, sum(h.amount) AS amount
       FROM optimal p JOIN history h ON CAST(date_trunc('month', h.day) AS DATE) = p.month
       GROUP BY ALL""",
    lambda x: x.optimal.join(
        x.history.groupBy("series_id", fd.month_start(F.col("day")).alias("month")).agg(
            F.sum("amount").alias("amount")
        ),
        "month",
    ),
)


@query("snk_results", "series_id month amount:2 n_days:i",
       "SELECT series_id, strftime(day, '%Y-%m') AS month, sum(amount) AS amount, "
       "count(*) AS n_days FROM history GROUP BY 1, 2")
def _(x: Inputs) -> DataFrame:
    totals = x.history.groupBy("series_id", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n_days")
    )
    path = f"{staging_root(x.spark)}/tidecast/{uuid.uuid4().hex}/results"
    sinks.publish(totals, path, "csv")
    return x.spark.read.schema("series_id string, month string, amount double, n_days long").csv(
        sinks.latest(x.spark, path), header=True
    )


# ------------------------------------------------------------ projections, filters

plain("channel_normalize", "loan_number:i channel",
      f"SELECT loan_number, {o.NORMAL_CHANNEL} AS channel FROM loans",
      lambda x: x.orders_as_loans.select(
          "loan_number", fp.normalized_channel(F.col("channel")).alias("channel")))
plain("channel_exclude", "loan_number:i channel",
      f"SELECT loan_number, channel FROM loans WHERE {o.KEPT}",
      lambda x: x.orders_as_loans.filter(fp.channel_kept(F.col("channel"))))
plain("date_parts", "loan_number:i y:i dow:i dom:i wom:i moy:i",
      f"""SELECT loan_number, year(funded_date) AS y, isodow(funded_date) - 1 AS dow,
        day(funded_date) AS dom, {o.wom('funded_date')} AS wom, month(funded_date) AS moy
        FROM loans WHERE funded_date IS NOT NULL""",
      lambda x: x.orders_as_loans.filter("funded_date is not null").select(
          "loan_number", F.year("funded_date").alias("y"),
          fd.weekday(F.col("funded_date")).alias("dow"), F.dayofmonth("funded_date").alias("dom"),
          fd.week_of_month(F.col("funded_date")).alias("wom"), F.month("funded_date").alias("moy")))
plain("trailing_years_filter", "loan_number:i funded_date",
      f"SELECT loan_number, funded_date FROM loans WHERE funded_date >= {o.FIVE_YEARS_SQL}",
      lambda x: x.orders_as_loans.filter(
          fp.trailing_years(F.col("funded_date"), F.lit(b.AS_OF), 5)))
plain("nth_future_bizday_bound", "loan_number:i funded_date",
      f"""SELECT loan_number, funded_date FROM loans
        WHERE funded_date > {AS_OF_SQL} - 30 AND funded_date <= (SELECT hi FROM bound)""",
      lambda x: x.orders_as_loans.filter(
          (F.col("funded_date") > F.date_sub(F.lit(b.AS_OF), 30))
          & (F.col("funded_date")
             <= cal_ops.nth_future_bizday_bound(x.calendar, b.AS_OF, 3).scalar())))
plain("date_range_filter", "run_id n:i amount:2",
      """SELECT run_id, count(*) AS n, sum(amount) AS amount FROM runs r JOIN history h
        ON h.series_id = r.series_id AND h.day BETWEEN r.train_start AND r.known_through
        GROUP BY 1""",
      lambda x: ev.run_actuals(
          x.history, x.runs, F.col("train_start"), F.col("known_through")
      ).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("actual").alias("amount")))
plain("weekday_filter", "series_id day amount:2",
      "SELECT * FROM history WHERE isodow(day) < 6",
      lambda x: x.history.filter(fd.is_weekday(F.col("day"))))
plain("positive_filter", "series_id day amount:2",
      "SELECT * FROM history WHERE amount > 0",
      lambda x: x.history.filter(F.col("amount") > 0))
plain("weekend_zero", "channel funded_date number_of_loans:i total_loan_amount:2",
      """SELECT channel, funded_date,
        CASE WHEN isodow(funded_date) > 5 THEN 0 ELSE number_of_loans END AS number_of_loans,
        CASE WHEN isodow(funded_date) > 5 THEN 0 ELSE total_loan_amount END AS total_loan_amount
        FROM lagg""",
      lambda x: fp.weekend_zero(x.per_day, "funded_date", daily_ops.MEASURES))
plain("null_fill", "calendar_date channel number_of_loans:i",
      """SELECT s.calendar_date, s.channel, coalesce(l.number_of_loans, 0) AS number_of_loans
        FROM spine s LEFT JOIN lagg l ON l.channel = s.channel
          AND l.funded_date = s.calendar_date""",
      lambda x: fn.null_fill(
          daily_ops.channel_spine(
              daily_ops.channels(x.orders_as_loans), x.calendar, b.AS_OF).join(
              x.per_day.withColumnRenamed("funded_date", "calendar_date"),
              ["calendar_date", "channel"], "left"),
          ["number_of_loans"]))
plain("numeric_coerce", "loan_number:i loan_status:2 loan_amount:2",
      """SELECT loan_number, try_cast(loan_status AS DOUBLE) AS loan_status,
        CAST(loan_amount AS DOUBLE) AS loan_amount FROM snaps""",
      lambda x: fn.numeric_coerce(
          x.snapshots, ["loan_number", "filedt", "channel"]))
plain("status_filter", "loan_number:i loan_status",
      f"SELECT loan_number, loan_status FROM snaps WHERE {o.STATUS_KEPT}",
      lambda x: fu.status_filter(x.snapshots))
plain("channel_split", "series_id n:i amount:2 first_day last_day",
      """SELECT series_id, count(*) AS n, sum(amount) AS amount, min(day) AS first_day,
        max(day) AS last_day FROM history GROUP BY 1""",
      lambda x: x.history.groupBy("series_id").agg(
          F.count("*").alias("n"), F.sum("amount").alias("amount"),
          F.min("day").alias("first_day"), F.max("day").alias("last_day")))
plain("safe_ratio", "filedt channel ratio:8",
      """SELECT filedt, channel, CASE WHEN application_count > 0
        THEN CAST(approval_events AS DOUBLE) / application_count ELSE 0 END AS ratio FROM fevents""",
      lambda x: _events(x).withColumn(
          "ratio", fn.safe_ratio(F.col("approval_events").cast("double"),
                                 F.col("application_count"))))
plain("safe_pct", "filedt channel pct:8",
      """SELECT filedt, channel, CASE WHEN underwriting_submission_events > 0
        THEN CAST(application_count - underwriting_submission_events AS DOUBLE)
          / underwriting_submission_events ELSE 0 END AS pct FROM fevents""",
      lambda x: _events(x).withColumn(
          "pct", fn.safe_pct(F.col("application_count").cast("double"),
                             F.col("underwriting_submission_events").cast("double"))))
plain("column_shape", "day amount:2 source channel",
      """SELECT calendar_date AS day, total_loan_amount AS amount, 'actual' AS source, channel
        FROM daily""",
      lambda x: x.daily.drop("is_holiday")
      .withColumnsRenamed({"calendar_date": "day", "total_loan_amount": "amount"})
      .withColumn("source", F.lit("actual")))
plain("source_label", "run_id day source",
      """SELECT run_id, day, CASE WHEN day <= known_through THEN 'actual' ELSE 'forecast' END
        AS source FROM runs r JOIN history h ON h.series_id = r.series_id
        AND h.day BETWEEN today AND output_through""",
      lambda x: ev.run_actuals(x.history, x.runs, F.col("today"), F.col("output_through"))
      .withColumn("source", fp.source_label(F.col("day"), F.col("known_through"))))


def _naive_forecast(x: Inputs) -> DataFrame:
    week_back = F.lag("amount", 7).over(Window.partitionBy("series_id").orderBy("day"))
    rows = x.history.withColumn("forecast", F.coalesce(week_back, F.lit(0.0)))
    return ev.run_actuals(rows, x.runs, F.col("today"), F.col("output_through")).withColumn(
        "model_used", F.lit("naive")
    )


plain("known_override", "run_id day actual:2 forecast:2 model_used",
      """SELECT run_id, day, amount AS actual,
        CASE WHEN day <= known_through THEN amount ELSE prev END AS forecast,
        CASE WHEN day <= known_through THEN 'actual' ELSE 'naive' END AS model_used
        FROM runs r JOIN (SELECT *, coalesce(lag(amount, 7) OVER (
            PARTITION BY series_id ORDER BY day), 0) AS prev FROM history) h
          ON h.series_id = r.series_id AND h.day BETWEEN today AND output_through""",
      lambda x: fp.known_override(_naive_forecast(x), "day", "known_through"))

# ------------------------------------------------------------ joins

plain("join_inner_equi", "loan_number:i filedt loan_amount:2 funded_date",
      """SELECT a.loan_number, a.filedt, a.loan_amount, l.funded_date FROM snaps a
        JOIN loans l ON l.loan_number = a.loan_number""",
      lambda x: x.snapshots.join(
          x.orders_as_loans.select("loan_number", "funded_date"), "loan_number"))


def _events(x: Inputs) -> DataFrame:
    return (
        fu.funnel_base(x.loans, x.snapshots)
        .join(fu.event_counts(x.loans, x.snapshots).withColumnRenamed("dt", "filedt"),
              ["filedt", "channel"], "left")
        .fillna(0, subset=fu.COUNT_COLUMNS + fu.VOLUME_COLUMNS)
    )


EVENTS = "application_count:i underwriting_submission_events:i approval_events:i"
VOLUMES = ("application_volume:2 underwriting_submission_event_volume:2 "
           "approval_event_volume:2")
plain("join_left_multikey", f"filedt channel loan_count:i {EVENTS} {VOLUMES}",
      "SELECT * FROM fevents", _events)
plain("join_cross_spine",
      "calendar_date channel biz_day:i funding_day:i is_holiday:i day_of_week:i day_of_month:i "
      "week_of_month:i month_of_year:i",
      "SELECT * FROM spine",
      lambda x: daily_ops.channel_spine(daily_ops.channels(x.orders_as_loans), x.calendar, b.AS_OF))
plain("join_left_degenerate", "filedt channel loan_count:i biz_day:i calendar_days_remaining:i",
      """SELECT f.filedt, f.channel, f.loan_count, c.biz_day, c.calendar_days_remaining
        FROM fbase f LEFT JOIN cal c ON c.calendar_date = f.filedt WHERE c.is_weekday = 1""",
      lambda x: fu.with_calendar(fu.funnel_base(x.loans, x.snapshots), x.calendar))
plain("join_calendar_flag", "channel funded_date is_holiday:i number_of_loans:i",
      """SELECT channel, funded_date, coalesce(c.is_holiday, 0) AS is_holiday, number_of_loans
        FROM lagg LEFT JOIN cal c ON c.calendar_date = funded_date""",
      lambda x: x.per_day.join(
          F.broadcast(x.calendar.select(F.col("calendar_date").alias("funded_date"),
                                        "is_holiday")), "funded_date", "left")
      .fillna(0, subset=["is_holiday"]))


@query("join_membership", "series_id member day amount:2",
       """SELECT series_id, CASE WHEN day IN (SELECT hday FROM hol) THEN 'holiday' ELSE 'other'
         END AS member, day, amount FROM history""")
def _(x: Inputs) -> DataFrame:
    days = F.broadcast(st.holiday_days(x.calendar).withColumnRenamed("calendar_date", "day"))
    inside = x.history.join(days, "day", "left_semi").withColumn("member", F.lit("holiday"))
    outside = x.history.join(days, "day", "left_anti").withColumn("member", F.lit("other"))
    return inside.unionByName(outside)


@query("join_effect_lookup", "run_id day dow_e:8 dom_e:8 moy_e:8",
       """SELECT z.run_id, z.day, CASE WHEN z.dow > 4 THEN 0 ELSE coalesce(w.e, 1) END AS dow_e,
         coalesce(o.e, 1) AS dom_e, coalesce(m.e, 1) AS moy_e
         FROM ma_hz z LEFT JOIN ma_dow w ON w.run_id = z.run_id AND w.dow = z.dow
         LEFT JOIN ma_dom o ON o.run_id = z.run_id AND o.dom = z.dom
         LEFT JOIN ma_moy m ON m.run_id = z.run_id AND m.moy = z.moy""")
def _(x: Inputs) -> DataFrame:
    _, _, effects = x.steps(st.MODEL_A)
    days = fo.forecast_horizon(fo.horizon_requests(x.runs, 2))
    dow = F.weekday("day")
    return days.join(effects, "run_id").select(
        "run_id", "day",
        F.when(dow > 4, F.lit(0.0)).otherwise(st.lookup("dow_effect", dow)).alias("dow_e"),
        st.lookup("dom_effect", F.dayofmonth("day")).alias("dom_e"),
        st.lookup("moy_effect", F.month("day")).alias("moy_e"),
    )


plain("join_period_shift", "series_id lead:i indicator month indicator_month regime value:6",
      "SELECT * FROM ladder_led",
      lambda x: sy.lead_lag_join(x.optimal, x.ladder))


def _run_windows(x: Inputs, days: int) -> DataFrame:
    end = F.date_sub("today", 1)
    return x.runs.select(
        F.col("run_id").alias("window_id"), "series_id",
        F.date_sub(end, days - 1).alias("start"), end.alias("end"),
        F.date_sub(end, 2 * days - 1).alias("prior_start"),
        F.date_sub(end, days).alias("prior_end"),
    )


FEATURE_LIST = " ".join(f"{f}:6" for f in [*an.LEVELS, *an.CHANGES, "biz_day_count"])


def _window_sql(start: str, end: str, prior_start: str, prior_end: str, rows: str,
                extra: str = "") -> str:
    cols = []
    for tag, lo, hi in (("c", start, end), ("p", prior_start, prior_end)):
        cond = f"f.filedt BETWEEN {lo} AND {hi}"
        cols += [f"coalesce(sum(f.{c}) FILTER ({cond}), 0) AS {m}_{tag}"
                 for m, c in an.MEASURES.items()]
        cols += [f"coalesce(sum(f.biz_day) FILTER ({cond}), 0) AS bz_{tag}",
                 f"CAST(count(f.filedt) FILTER ({cond}) AS DOUBLE) AS rw_{tag}"]
    return (f"SELECT w.window_id, w.series_id, {', '.join(cols)}{extra} FROM ({rows}) w "
            f"LEFT JOIN fseries f ON f.series_id = w.series_id "
            f"AND f.filedt BETWEEN {prior_start} AND {end} GROUP BY 1, 2")


def _features_of(sums: str) -> str:
    return (f"SELECT window_id, series_id, "
            f"{o.features_sql('{m}_c', '{m}_p', o.bz('c'), o.bz('p'))}, "
            f"{o.bz('c')} AS biz_day_count FROM ({sums})")


_RUN_ROWS = "SELECT run_id AS window_id, series_id, today FROM runs"
_W30 = _features_of(_window_sql("w.today - 30", "w.today - 1", "w.today - 60", "w.today - 31",
                                _RUN_ROWS))
_W60 = _features_of(_window_sql("w.today - 60", "w.today - 1", "w.today - 120", "w.today - 61",
                                _RUN_ROWS))
plain("join_range_window", "window_id apps_count_per_biz_day:6 apps_vol_per_biz_day:4 biz_day_count:2",
      _W30, lambda x: an.volume_features(x.funnel, _run_windows(x, 30)))


@query("join_nearest_date", "run_id window_start recency_strength:4",
       """SELECT run_id, month AS window_start, recency_strength FROM (
         SELECT r.run_id, p.month, p.recency_strength, row_number() OVER (PARTITION BY r.run_id
           ORDER BY abs(p.month - r.forecast_start), p.month) AS rn
         FROM runs r CROSS JOIN optimal p) WHERE rn = 1""")
def _(x: Inputs) -> DataFrame:
    months = F.explode(F.array(*[F.lit(r[0] + "-01") for r in readers.MONTHLY_OPTIMAL_PARAMS]))
    per_series = x.series.select(
        F.col("series_id").alias("channel"), months.alias("m")
    ).select("channel", F.add_months(F.to_date("m"), b.MONTH_SHIFT).alias("window_start"))
    anchors = per_series.join(
        x.optimal.select(F.col("month").alias("window_start"), "recency_strength"), "window_start"
    )
    targets = x.runs.withColumnRenamed("forecast_start", "target_start")
    return an.nearest_anchor(targets, anchors)


def _distances(x: Inputs) -> DataFrame:
    queries = an.analog_queries(x.index.signatures, x.runs, x.index.norm)
    return an.analog_distance(queries, x.index.candidates)


plain("join_knn", "run_id origin distance:6",
      """SELECT run_id, origin, distance FROM (SELECT *, row_number() OVER (
        PARTITION BY run_id ORDER BY distance, origin) AS rn FROM an_d) WHERE rn = 1""",
      lambda x: an.analog_topk_min_gap(_distances(x), 1, 1))
plain("join_actual_forecast", "run_id day forecast:2 actual:2",
      """SELECT f.run_id, f.day, f.forecast, h.amount AS actual FROM rfc f
        JOIN runs r ON r.run_id = f.run_id
        JOIN history h ON h.series_id = r.series_id AND h.day = f.day""",
      lambda x: ev.join_actual_forecast(
          x.labelled(st.MODEL_R),
          ev.run_actuals(x.history, x.runs, F.col("forecast_start"), F.lit(UNTIL)), "inner"))


def _ranked_fits(x: Inputs, matches: DataFrame) -> DataFrame:
    """The regime parameter sets stand in for tuned ones, by rank of the match."""
    params = rg.regime_params(x.spark).drop("regime").withColumn("rank", F.col("param_id") + 1)
    return matches.select("run_id", "rank").join(
        F.broadcast(params.drop("param_id")), "rank"
    ).select("run_id", F.col("rank").cast("long").alias("param_id"), *PARAM_NAMES)


o.table("jb_fits", "SELECT t.run_id, CAST(t.rank AS BIGINT) AS param_id, "
        + ", ".join(f"p.{c}" for c in PARAM_NAMES)
        + " FROM an_top t JOIN rparams p ON p.param_id + 1 = t.rank")
o.add_model("jb", st.MODEL_R, "runs", "jb_fits", "req2")
o.table("jb_w", """
SELECT run_id, rank, distance, (1 / (distance + 1e-3)) / sum(1 / (distance + 1e-3)) OVER (
  PARTITION BY run_id) AS weight FROM an_top""")


@query("join_blend", "run_id day forecast:2",
       """SELECT f.run_id, f.day, sum(f.forecast * w.weight) AS forecast FROM jb_fc f
         JOIN jb_w w ON w.run_id = f.run_id AND w.rank = f.param_id GROUP BY 1, 2""")
def _(x: Inputs) -> DataFrame:
    matches = stage(af.find_analogs(x.index, x.runs, 3, 14), "matches")
    fit = st.fit_model(x.history, x.runs, _ranked_fits(x, matches), x.calendar, st.MODEL_R)
    fc = fo.forecast(fit, fo.horizon_requests(x.runs, 2), x.calendar)
    return af.ensemble_inverse_distance(fc, matches)


plain("ensemble_inverse_distance", "run_id rank:i distance:6 weight:8", "SELECT * FROM jb_w",
      lambda x: af.match_weights(af.find_analogs(x.index, x.runs, 3, 14)))

# ------------------------------------------------------------ aggregations

plain("agg_daily_channel", "channel funded_date number_of_loans:i total_loan_amount:2",
      "SELECT * FROM lagg", lambda x: x.per_day)
plain("agg_event_counts", f"dt channel {EVENTS} {VOLUMES}",
      """SELECT dt, channel, coalesce(application_count, 0) AS application_count,
        application_volume, coalesce(underwriting_submission_events, 0)
          AS underwriting_submission_events, underwriting_submission_event_volume,
        coalesce(approval_events, 0) AS approval_events, approval_event_volume
        FROM ev_application FULL JOIN ev_submission USING (dt, channel)
        FULL JOIN ev_approval USING (dt, channel)""",
      lambda x: fu.event_counts(x.loans, x.snapshots))
plain("agg_event_counts_simple", f"dt channel {EVENTS}",
      """SELECT dt, channel, coalesce(application_count, 0) AS application_count,
        coalesce(underwriting_submission_events, 0) AS underwriting_submission_events,
        coalesce(approval_events, 0) AS approval_events
        FROM evs_application FULL JOIN evs_submission USING (dt, channel)
        FULL JOIN evs_approval USING (dt, channel)""",
      lambda x: fu.event_counts_simple(x.loans))
FUNNEL_BASE = ("filedt channel loan_count:i loan_volume:2 funded_loan_count:i "
               "funded_loan_volume:2 underwriting_submission_count:i "
               "initial_conditional_approval_count:i")
plain("agg_funnel_daily", FUNNEL_BASE, "SELECT * FROM fbase",
      lambda x: fu.funnel_base(x.loans, x.snapshots))
plain("agg_pull_through", "filedt channel pull_through_pct_count:2 pull_through_pct_volume:2",
      "SELECT *, " + ", ".join(map(o.pull_sql, o.PULL)) + " FROM fbase",
      lambda x: fu.funnel_base(x.loans, x.snapshots).withColumns({
          "pull_through_pct_count": fu.pull_through("funded_loan_count", "loan_count"),
          "pull_through_pct_volume": fu.pull_through("funded_loan_volume", "loan_volume")}))
plain("agg_avg_size",
      "filedt channel avg_application_loan_size:2 avg_underwriting_submission_loan_size:2 "
      "avg_approval_loan_size:2",
      "SELECT * FROM funnel", lambda x: x.funnel_daily)
CALS = ("biz_day:i biz_day_remaining_in_month:i biz_days_in_month:i is_holiday:i "
        "is_company_holiday:i calendar_days_remaining:i")
plain("funnel_daily",
      f"{FUNNEL_BASE} {EVENTS} {VOLUMES} pull_through_pct_count:2 pull_through_pct_volume:2 "
      "avg_application_loan_size:2 avg_underwriting_submission_loan_size:2 "
      f"avg_approval_loan_size:2 {CALS}",
      "SELECT * FROM funnel", lambda x: x.funnel_daily)
plain("funnel_daily_simple",
      f"{FUNNEL_BASE} {EVENTS} pull_through_pct_count:2 pull_through_pct_volume:2 {CALS}",
      "SELECT * FROM funnel_old",
      lambda x: fu.funnel_daily_simple(x.loans, x.snapshots, x.calendar))


def _funnel_stream(x: Inputs) -> DataFrame:
    return fu.funnel_series(x.funnel_daily)


EVENT_SUMS = " ".join(f"{c}:2" for c in ind.EVENT_SUMS)
plain("agg_monthly_sum", f"series_id month {EVENT_SUMS}", "SELECT * FROM mfull_m",
      lambda x: ind.month_sums(_funnel_stream(x), ind.EVENT_SUMS))
plain("agg_monthly_calendar",
      "series_id month biz_days_in_month:2 biz_days_with_data:2 holiday_count:2 "
      "company_holiday_count:2 min_biz_remaining:2 min_cal_remaining:2",
      "SELECT * FROM mwide_m",
      lambda x: ind.month_sums(_funnel_stream(x), ["loan_count"], *ind.calendar_aggregates()))
plain("agg_pull_through_monthly",
      "series_id month pull_through_pct_count:6 pull_through_pct_volume:6",
      "SELECT * FROM mwide",
      lambda x: ind.pull_through_monthly(ind.month_sums(_funnel_stream(x), ind.WIDE_SUMS)))
plain("agg_mean_effect", "series_id moy:i raw:2 effect:8",
      """SELECT *, raw / avg(raw) OVER (PARTITION BY series_id) AS effect FROM (
        SELECT series_id, month(day) AS moy, avg(amount) AS raw FROM history
        WHERE isodow(day) < 6 GROUP BY 1, 2)""",
      lambda x: st.mean_effect(
          x.history.filter(F.weekday("day") < 5).withColumn("moy", F.month("day")),
          ["series_id"], ["moy"], F.col("amount")))


def _effect_rows(effects: DataFrame, column: str) -> DataFrame:
    return effects.select("run_id", F.explode(column).alias("k", "e"))


plain("agg_weighted_mean", "run_id k:i e:8", "SELECT run_id, moy AS k, e FROM mbm_moy",
      lambda x: _effect_rows(x.steps(o.MODEL_B_MOM)[2], "moy_effect"))
plain("agg_median", "series_id dow:i median_amount:2 n:i",
      """SELECT series_id, isodow(day) - 1 AS dow, median(amount) AS median_amount, count(*) AS n
        FROM history GROUP BY 1, 2""",
      lambda x: _median_by_weekday(x.history.withColumn("dow", F.weekday("day"))))
plain("agg_mad", "series_id median:2 mad:2",
      """SELECT h.series_id, any_value(m) AS median, 1.4826 * median(abs(h.amount - m)) AS mad
        FROM history h JOIN (SELECT series_id, median(amount) AS m FROM history
          WHERE isodow(day) < 6 GROUP BY 1) k ON k.series_id = h.series_id
        WHERE isodow(day) < 6 GROUP BY 1""",
      lambda x: _mad(x.history.filter(F.weekday("day") < 5)))


def _median_by_weekday(rows: DataFrame) -> DataFrame:
    keys = ["series_id", "dow"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(
        exact_median(rows, keys, F.col("amount"), "median_amount"), keys)


def _mad(rows: DataFrame) -> DataFrame:
    center = exact_median(rows, ["series_id"], F.col("amount"))
    away = join_salted(rows, center, "series_id", "day")
    mad = exact_median(away, ["series_id"], F.abs(F.col("amount") - F.col("median")), "mad")
    return center.join(mad.withColumn("mad", F.lit(an.MAD_TO_SIGMA) * F.col("mad")), "series_id")


plain("agg_stddev", "series_id sd_pop:2 sd_samp:2",
      """SELECT series_id, stddev_pop(amount) AS sd_pop, stddev_samp(amount) AS sd_samp
        FROM history GROUP BY 1""",
      lambda x: x.history.groupBy("series_id").agg(
          F.stddev_pop("amount").alias("sd_pop"), F.stddev_samp("amount").alias("sd_samp")))
CORR = "series_id lead:i indicator param correlation:3 n_obs:i"
plain("agg_corr", CORR, "SELECT * FROM corrs", lambda x: x.correlations)
plain("agg_regime_stats", "series_id regime indicator mean:6 median:6 min:6 max:6 n:i",
      " UNION ALL ".join(
          f"""SELECT series_id, regime, '{c}' AS indicator, avg({c}) AS mean,
          median({c}) AS median, min({c}) AS min, max({c}) AS max, count({c}) AS n
          FROM merged_one GROUP BY 1, 2""" for c in sy.KEY_INDICATORS),
      lambda x: sy.regime_stats(x.lead_one))
plain("agg_value_counts", "param value:4 n:i",
      " UNION ALL ".join(
          f"SELECT '{p}' AS param, CAST({p} AS DOUBLE) AS value, count(*) AS n FROM wm_best "
          "GROUP BY 2" for p in PARAM_NAMES),
      lambda x: sw.value_counts(x.month_best))
BANDS = "n:i mean_abs_err:6 median_abs_err:6 max_abs_err:6 within_5:i within_10:i within_15:i"


def _bands_sql(rows: str, err: str, keys: str = "") -> str:
    a = f"abs({err})"
    head = f"{keys}, " if keys else ""
    return (f"SELECT {head}count({err}) AS n, avg({a}) AS mean_abs_err, "
            f"median({a}) AS median_abs_err, max({a}) AS max_abs_err, "
            + ", ".join(f"count(*) FILTER ({a} <= {k}) AS within_{k}" for k in (5, 10, 15))
            + f", avg(0) AS zero FROM {rows}" + (f" GROUP BY {keys}" if keys else ""))


plain("agg_within_band", f"series_id {BANDS}",
      _bands_sql("evi", "pct_err", "series_id"),
      lambda x: ev.within_bands(
          ev.eval_frame(x.history, x.labelled(st.MODEL_R), x.runs), "pct_err", "series_id"))


def _report(x: Inputs) -> DataFrame:
    evaluated = ev.eval_frame(x.history, x.labelled(st.MODEL_R), x.runs)
    return ev.report_rows(x.history, evaluated, x.runs)


plain("agg_error_totals",
      "run_id total_actual:2 total_forecast:2 total_diff:2 total_pct:6 mae:2 mape:6 n_scored:i",
      """SELECT *, total_forecast - total_actual AS total_diff,
        (total_forecast - total_actual) / total_actual * 100 AS total_pct FROM rtotals""",
      lambda x: ev.error_totals(_report(x), "run_id"))
plain("agg_monthly_totals", "run_id month total:2",
      """SELECT run_id, CAST(date_trunc('month', day) AS DATE) AS month, sum(amount) AS total
        FROM runs r JOIN history h ON h.series_id = r.series_id
          AND h.day BETWEEN r.train_start AND r.train_end GROUP BY 1, 2""",
      lambda x: st.fit_monthly_totals(x.history, x.runs))


def _classified(x: Inputs) -> DataFrame:
    scored = stage(x.scored, "scored")
    return sy.classification_table(scored, sy.best_threshold(sy.threshold_scan(scored)))


plain("agg_accuracy", "series_id correct:i total:i accuracy:6",
      """SELECT series_id, count(*) FILTER (regime = predicted_regime) AS correct,
        count(*) AS total, avg(CASE WHEN regime = predicted_regime THEN 1.0 ELSE 0 END) AS accuracy
        FROM classified GROUP BY 1""",
      lambda x: sy.accuracy(_classified(x)))

# ------------------------------------------------------------ windows

plain("win_calendar_weights",
      "channel funded_date week_weight:8 day_of_week_weight:8 day_of_month_weight:8",
      "SELECT * FROM lagg", lambda x: daily_ops.calendar_weights(x.per_day))
plain("win_ratio_of_total",
      "channel funded_date month_to_month_weight_loans:8 month_to_month_weight_amount:8",
      "SELECT * FROM lagg", lambda x: daily_ops.calendar_weights(x.per_day))
plain("win_weight_ratios",
      "channel funded_date week_amount_weight:8 day_of_week_amount_weight:8 "
      "day_of_month_amount_weight:8 month_within_year_weight_loans:8 "
      "month_within_year_weight_amount:8",
      "SELECT * FROM lagg", lambda x: daily_ops.calendar_weights(x.per_day))
plain("win_row_number", "channel calendar_date rn:i",
      f"""SELECT channel, calendar_date, row_number() OVER (PARTITION BY channel
        ORDER BY calendar_date) AS rn FROM daily
        WHERE calendar_date > {TODAY_SQL} AND biz_day = 1""",
      lambda x: x.daily.filter((F.col("calendar_date") > F.lit(b.TODAY))
                               & (F.col("biz_day") == 1)).withColumn(
          "rn", F.row_number().over(
              Window.partitionBy("channel").orderBy("calendar_date"))))
MTD = ("series_id month application_count:2 approval_events:2 underwriting_submission_events:2 "
       "effective_biz_days:2 application_count_per_bizday:6 approval_events_per_bizday:6 "
       "underwriting_submission_events_per_bizday:6 application_count_per_bizday_growth_1m:6 "
       "application_count_per_bizday_growth_3m:6 approval_events_per_bizday_growth_1m:6 "
       "underwriting_submission_events_per_bizday_growth_1m:6")
plain("win_pct_change", "series_id month indicator value:6",
      "SELECT * FROM ladder WHERE contains(indicator, '_growth_')",
      lambda x: x.ladder.filter(F.col("indicator").contains("_growth_")))
SMOOTHED = ("series_id month application_count_per_bizday_growth_1m:6 "
            "approval_events_per_bizday_growth_1m:6")
plain("win_rolling_mean", SMOOTHED, o.smooth_sql("mtd"), lambda x: ind.smooth_growth(x.mtd))
TRAIN_A = f"SELECT * FROM ma_pr WHERE n_prod - p <= {st.MODEL_A.defaults['level_lookback_days']}"
plain("win_tail_n", "run_id day y:2 p:i", TRAIN_A,
      lambda x: x.train(st.MODEL_A).filter(
          F.col("prod") & (F.col("n_prod") - F.col("p")
                           <= st.MODEL_A.defaults["level_lookback_days"])))
plain("win_time_index", "run_id day t:i p:i n_prod:i n_train:i",
      "SELECT run_id, day, t, p, n_prod, n_train FROM ma_pr",
      lambda x: x.train(st.MODEL_A).filter("prod"))
plain("win_recency_weight", "run_id day w:8",
      "SELECT run_id, day, exp(0.35 * p / n_prod) AS w FROM ma_pr",
      lambda x: x.train(st.MODEL_A).filter("prod").withColumn(
          "w", F.exp(0.35 * F.col("p") / F.col("n_prod"))))


@query("win_rank_exp_weight", "run_id day w:8",
       """SELECT run_id, day, exp(2.0 * (m - rk) / (m - 1)) / sum(exp(2.0 * (m - rk) / (m - 1)))
         OVER (PARTITION BY run_id) AS w
         FROM (SELECT run_id, day, n_prod - p AS rk, least(30, n_prod) AS m FROM mr_pr)
         WHERE rk <= 30""")
def _(x: Inputs) -> DataFrame:
    rank = F.col("n_prod") - F.col("p")
    n = F.least(F.lit(30), F.col("n_prod"))
    raw = F.exp(F.coalesce(F.try_divide(2.0 * (n - rank), (n - 1).cast("double")), F.lit(0.0)))
    tail = x.train(st.MODEL_R).filter(F.col("prod") & (rank <= 30)).withColumn("raw", raw)
    return tail.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("run_id")))


plain("win_horizon_normalise", "run_id day seasonal:8",
      "SELECT run_id, day, sn AS seasonal FROM ma_fc", lambda x: x.forecast(st.MODEL_A))
LEVELS_1M = " ".join(f"{f}_1m:4" for f in an.LEVELS)
plain("win_trailing_range", f"series_id origin {LEVELS_1M} biz_day_count_forecast:2",
      "SELECT * FROM sigs", lambda x: an.two_window_signature(_funnel_stream(x), UNTIL))
REPORT = "run_id series_id day source model_used actual:2 forecast:2 diff:2 pct_err:6"
plain("win_dedupe_first", REPORT, "SELECT * FROM rrows", _report)
plain("win_latest_row", MTD,
      f"SELECT * FROM (SELECT *, {o.LATEST} AS rn FROM mtd) WHERE rn = 1",
      lambda x: ind.latest_month(x.mtd))
plain("win_bizday_position", "run_id day pos:i",
      """SELECT run_id, day, row_number() OVER (PARTITION BY run_id ORDER BY day) - 1 AS pos
        FROM ma_tr WHERE dow < 5""",
      lambda x: x.train(st.MODEL_A))

# ------------------------------------------------------------ sort, top-k, sets

DAILY = ("calendar_date channel biz_day:i funding_day:i funding_day_remaining_in_month:i "
         "biz_day_remaining_in_month:i is_holiday:i day_of_week:i day_of_month:i "
         "week_of_month:i month_of_year:i number_of_loans:i total_loan_amount:2 "
         + " ".join(f"{w}:8" for w in daily_ops.WEIGHT_COLUMNS))
plain("daily_history", DAILY, "SELECT * FROM daily", lambda x: x.daily)
plain("sort_output", "calendar_date channel number_of_loans:i total_loan_amount:2",
      "SELECT * FROM daily ORDER BY calendar_date, channel",
      lambda x: sinks.sort_output(x.daily, "calendar_date", "channel"))
plain("topk_global", CORR + " abs_corr:3",
      """SELECT * FROM corrs ORDER BY abs_corr DESC, series_id, lead, indicator, param
        LIMIT 50""",
      lambda x: sy.top_correlations(x.correlations, 50))
plain("topk_per_group", CORR,
      """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, param
        ORDER BY abs_corr DESC, lead, indicator) AS rn FROM corrs) WHERE rn = 1""",
      lambda x: sy.best_per_param(x.correlations))
plain("topk_distinct", CORR + " rank:i",
      """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id
          ORDER BY abs_corr DESC, lead, indicator) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id, indicator
            ORDER BY abs_corr DESC, lead) AS rn FROM corrs WHERE param = 'regime_numeric')
        WHERE rn = 1) WHERE rank <= 6""",
      lambda x: sy.top_distinct(x.correlations, 6))
MATCHES = "run_id series_id rank:i distance:6 origin target_start target_end"
plain("topk_min_gap", MATCHES, "SELECT * FROM an5_top",
      lambda x: af.find_analogs(x.index, x.runs, 5, 14))
BEST = ("run_id param_id:i forecast_total:2 actual_total:2 signed_pct_err:6 abs_pct_err:6 "
        "recency_strength:6 dow_shrinkage:6 interaction_shrinkage:6 seasonal_exponent:6 "
        "trend_dampening:6 forward_lift_daily:6 level_lookback_days:i trend_seasonal_tilt:6")
plain("argmin_params", "run_id param_id:i abs_pct_err:6", "SELECT * FROM wm_best",
      lambda x: x.month_best)
plain("set_distinct", "channel", "SELECT * FROM chans",
      lambda x: daily_ops.channels(x.orders_as_loans))
STITCHED = """
SELECT r.run_id, r.series_id, h.day, h.amount, 'actual' AS source, '-' AS model_used
FROM runs r JOIN history h ON h.series_id = r.series_id
  AND h.day BETWEEN r.today AND r.known_through WHERE isodow(h.day) < 6
UNION ALL
SELECT f.run_id, r.series_id, f.day, f.forecast, 'forecast', f.model_used
FROM rfc f JOIN runs r ON r.run_id = f.run_id
WHERE isodow(f.day) < 6"""
STITCH = "run_id series_id day amount:2 source model_used"
plain("stitch_actual_forecast", STITCH, STITCHED,
      lambda x: ev.stitch_actual_forecast(x.history, x.labelled(st.MODEL_R), x.runs))
plain("set_union_all", "series_id day amount:2 source",
      """SELECT series_id, day, amount, 'daily' AS source FROM history UNION ALL
        SELECT series_id, filedt, application_volume, 'funnel' FROM fseries""",
      lambda x: x.history.withColumn("source", F.lit("daily")).unionByName(
          _funnel_stream(x).select("series_id", F.col("filedt").alias("day"),
                                   F.col("application_volume").alias("amount"),
                                   F.lit("funnel").alias("source"))))
plain("set_union_anchor_channels", "label channel window_start abs_err:4",
      "SELECT * FROM anchors WHERE channel IN ('Wholesale', 'Retail Broker')",
      lambda x: reg.union_anchor_channels(
          x.anchors.filter("channel = 'Wholesale'"), x.anchors.filter("channel = 'Retail Broker'")))
plain("set_drop_duplicates", "run_id day source",
      "SELECT run_id, day, source FROM rrows", _report)

# ------------------------------------------------------------ scalar functions

plain("fn_dates", "loan_number:i m0 m1 next_month days:i iso_week:i months:i",
      f"""SELECT loan_number, CAST(date_trunc('month', unified_app_date) AS DATE) AS m0,
        last_day(unified_app_date) AS m1,
        CAST(unified_app_date + INTERVAL 1 MONTH AS DATE) AS next_month,
        CAST(DATE '{b.TODAY}' - unified_app_date AS INTEGER) AS days,
        weekofyear(unified_app_date) AS iso_week,
        {o.SPAN.format('unified_app_date', TODAY_SQL)} AS months FROM loans""",
      lambda x: x.orders_as_loans.select(
          "loan_number", fd.month_start(F.col("unified_app_date")).alias("m0"),
          F.last_day("unified_app_date").alias("m1"),
          F.add_months("unified_app_date", 1).alias("next_month"),
          F.datediff(F.lit(b.TODAY), "unified_app_date").alias("days"),
          F.weekofyear("unified_app_date").alias("iso_week"),
          fd.months_spanned(F.col("unified_app_date"), F.lit(b.TODAY)).alias("months")))
plain("fn_math", "series_id day ln_amount:8 root:6 powered:4 clipped:2 gap:2",
      """SELECT series_id, day, ln(amount) AS ln_amount, sqrt(amount) AS root,
        pow(amount / 1000, 1.02) AS powered, greatest(1000.0, least(300000.0, amount)) AS clipped,
        abs(amount - 250000) AS gap FROM history WHERE amount > 0""",
      lambda x: x.history.filter("amount > 0").select(
          "series_id", "day", F.ln("amount").alias("ln_amount"), F.sqrt("amount").alias("root"),
          F.pow(F.col("amount") / 1000, F.lit(1.02)).alias("powered"),
          fn.clip(F.col("amount"), 1000.0, 300000.0).alias("clipped"),
          F.abs(F.col("amount") - 250000).alias("gap")))
plain("fn_labels", "series_id day weekday_name label",
      """SELECT series_id, day, strftime(day, '%a') AS weekday_name,
        strftime(day, '%b %d') AS label FROM history""",
      lambda x: x.history.select("series_id", "day", F.date_format("day", "EEE").alias(
          "weekday_name"), F.date_format("day", "MMM dd").alias("label")))

# ------------------------------------------------------------ calendar

plain("calendar_spine", "channel day n:i",
      """SELECT s.channel, s.day, count(l.loan_number) AS n FROM (
        SELECT channel, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT channel, min(funded_date) AS lo, max(funded_date) AS hi FROM loans
          GROUP BY 1)) s
        LEFT JOIN loans l ON l.channel = s.channel AND l.funded_date = s.day GROUP BY 1, 2""",
      lambda x: _dense_days(x))


def _dense_days(x: Inputs) -> DataFrame:
    per_day = x.orders_as_loans.filter("funded_date is not null").groupBy(
        "channel", F.col("funded_date").alias("day")).agg(F.count("*").alias("n"))
    bounds = per_day.groupBy("channel").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = bounds.select("channel", F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(per_day, ["channel", "day"], "left").fillna(0, subset=["n"])


plain("us_federal_holidays", "calendar_date n_loans:i",
      """SELECT hday AS calendar_date, count(l.loan_number) AS n_loans FROM hol
        LEFT JOIN loans l ON l.funded_date = hday GROUP BY 1""",
      lambda x: cal_ops.us_federal_holidays(x.spark, *b.calendar_range(x.spark, x.directory)).join(
          x.orders_as_loans.groupBy(F.col("funded_date").alias("calendar_date")).agg(
              F.count("*").alias("n_loans")), "calendar_date", "left").fillna(
          0, subset=["n_loans"]))
CAL_ALL = ("calendar_date is_weekday:i is_holiday:i is_company_holiday:i biz_day:i funding_day:i "
           "biz_days_in_month:i biz_day_remaining_in_month:i funding_day_remaining_in_month:i "
           "calendar_days_remaining:i")
plain("calendar_dimension", CAL_ALL + " n_loans:i",
      """SELECT c.*, coalesce(n, 0) AS n_loans FROM cal c LEFT JOIN (
        SELECT funded_date, count(*) AS n FROM loans GROUP BY 1) l
        ON l.funded_date = c.calendar_date""",
      lambda x: x.calendar.join(
          x.orders_as_loans.groupBy(F.col("funded_date").alias("calendar_date")).agg(
              F.count("*").alias("n_loans")), "calendar_date", "left").fillna(
          0, subset=["n_loans"]))
plain("business_day_add", "loan_number:i back_1 ahead_1 ahead_3 ahead_20",
      """SELECT loan_number, a.hit AS back_1, c.hit AS ahead_1, d.hit AS ahead_3, e.hit AS ahead_20
        FROM loans l JOIN bdstep a ON a.d = l.unified_app_date AND a.n = -1
        JOIN bdstep c ON c.d = l.unified_app_date AND c.n = 1
        JOIN bdstep d ON d.d = l.unified_app_date AND d.n = 3
        JOIN bdstep e ON e.d = l.unified_app_date AND e.n = 20""",
      lambda x: x.orders_as_loans.select("loan_number", *[
          fd.business_day_add(F.col("unified_app_date"), n).alias(name)
          for name, n in (("back_1", -1), ("ahead_1", 1), ("ahead_3", 3), ("ahead_20", 20))]))
plain("business_day_count", "run_id n_biz_days:i",
      """SELECT run_id, (SELECT count(*) FROM alldays a WHERE a.d BETWEEN r.forecast_start
          AND r.output_through AND isodow(a.d) < 6 AND a.d NOT IN (SELECT hday FROM hol))
        AS n_biz_days FROM runs r""",
      lambda x: cal_ops.business_day_count(
          x.runs, x.calendar, "forecast_start", "output_through"))
plain("run_windows", "run_id today known_through forecast_start forecast_end output_through",
      f"""SELECT h.channel || '@' || CAST(h.funded_date AS VARCHAR) AS run_id,
        h.funded_date AS today, k.hit AS known_through, f.hit AS forecast_start,
        e.hit AS forecast_end, z.hit AS output_through
        FROM lagg h JOIN bdstep k ON k.d = h.funded_date AND k.n = 3
        JOIN bdstep f ON f.d = h.funded_date AND f.n = 4
        JOIN bdstep e ON e.d = f.hit AND e.n = 19
        JOIN bdstep z ON z.d = h.funded_date AND z.n = 29""",
      lambda x: cal_ops.run_windows(
          x.per_day.select(F.col("channel").alias("series_id"),
                           F.col("funded_date").alias("today")), b.TRAIN_START))

# ------------------------------------------------------------ signatures, analogs

plain("volume_features", f"window_id {FEATURE_LIST}", _W60,
      lambda x: an.volume_features(x.funnel, _run_windows(x, 60)))
plain("windowed_features", f"window_id {FEATURE_LIST}", _W30,
      lambda x: an.volume_features(x.funnel, _run_windows(x, 30)))
FEATURES = " ".join(f"{f}:5" for f in an.FEATURES)
plain("two_window_signature", f"series_id origin {FEATURES}", "SELECT * FROM sigs",
      lambda x: an.two_window_signature(_funnel_stream(x), UNTIL))
_LEG_START = "CAST(w.today - 1 - INTERVAL 1 MONTH AS DATE)"
_LEG_PRIOR = "CAST(CAST(w.today - 1 - INTERVAL 1 MONTH AS DATE) - INTERVAL 1 MONTH AS DATE)"
_LEG_SIZES = "".join(
    f", coalesce(avg(f.{c}) FILTER (f.filedt BETWEEN {_LEG_START} AND w.today - 1), 0) AS {n}"
    for n, c in (("avg_app_loan_size", "avg_application_loan_size"),
                 ("avg_uw_loan_size", "avg_underwriting_submission_loan_size"),
                 ("avg_appr_loan_size", "avg_approval_loan_size")))
plain("legacy_volume_signature",
      "window_id apps_vol_total:2 apps_vol_per_biz_day:4 apps_vol_pct_chg:6 uw_vol_total:2 "
      "uw_vol_per_biz_day:4 uw_vol_pct_chg:6 appr_vol_total:2 appr_vol_per_biz_day:4 "
      "appr_vol_pct_chg:6 biz_day_count:2 avg_app_loan_size:4 avg_uw_loan_size:4 "
      "avg_appr_loan_size:4",
      f"SELECT *, apps_vol_c AS apps_vol_total, uw_vol_c AS uw_vol_total, "
      f"appr_vol_c AS appr_vol_total, {o.bz('c')} AS biz_day_count, "
      f"{o.features_sql('{m}_c', '{m}_p', o.bz('c'), o.bz('p'))} FROM ("
      + _window_sql(_LEG_START, "w.today - 1", _LEG_PRIOR, f"{_LEG_START} - 1", _RUN_ROWS,
                    _LEG_SIZES) + ")",
      lambda x: an.legacy_volume_signature(x.funnel, x.runs.select("series_id", "today")))
plain("candidate_window_index", f"series_id origin target_start target_end {FEATURES}",
      "SELECT * FROM cands", lambda x: x.index.candidates)
plain("robust_norm_stats", "series_id feature median:5 mad:5 scale:5", "SELECT * FROM nlong",
      lambda x: x.index.norm)
plain("zscore_norm_stats", "series_id feature mean:5 std:5",
      " UNION ALL ".join(f"SELECT series_id, '{f}' AS feature, avg({f}) AS mean, "
                         f"stddev_samp({f}) AS std FROM cands GROUP BY 1" for f in an.FEATURES),
      lambda x: an.zscore_norm_stats(x.index.candidates, an.FEATURES, "series_id"))
plain("feature_weights", "run_id feature weight:4",
      " UNION ALL ".join(f"SELECT run_id, '{f}' AS feature, {o.weight_sql(f)} AS weight "
                         f"FROM an_q q" for f in an.FEATURES),
      lambda x: x.runs.select("run_id", "series_id", F.col("forecast_start").alias("origin"))
      .join(x.index.signatures, ["series_id", "origin"])
      .select("run_id", F.explode(F.arrays_zip(
          F.array(*[F.lit(f) for f in an.FEATURES]).alias("feature"),
          an.feature_weights().alias("weight"))).alias("e"))
      .select("run_id", F.col("e.feature").alias("feature"), F.col("e.weight").alias("weight")))
plain("analog_distance", "run_id series_id origin distance:6", "SELECT * FROM an_d", _distances)
plain("analog_topk_min_gap", MATCHES, "SELECT * FROM an_top",
      lambda x: af.find_analogs(x.index, x.runs, 3, 14))
plain("distance_warning", "run_id best_distance:6 far",
      f"""SELECT run_id, min(distance) AS best_distance, min(distance) > {an.DISTANCE_WARNING}
        AS far FROM an_top GROUP BY 1""",
      lambda x: an.distance_warning(af.find_analogs(x.index, x.runs, 3, 14)))

_ANCHOR_ROWS = "SELECT label AS window_id, channel AS series_id, window_start AS ws FROM anchors"
_A_START = "CAST(w.ws - INTERVAL 2 MONTH AS DATE)"
_A_PRIOR = "CAST(CAST(w.ws - INTERVAL 2 MONTH AS DATE) - INTERVAL 2 MONTH AS DATE)"
o.table("afeat", _features_of(
    _window_sql(_A_START, "w.ws - 1", _A_PRIOR, f"{_A_START} - 1", _ANCHOR_ROWS)))
plain("anchor_feature_table", f"window_id {FEATURE_LIST}", "SELECT * FROM afeat",
      lambda x: an.anchor_feature_table(x.anchors, x.funnel))
_L_ROWS = "SELECT run_id AS window_id, series_id, today AS ws FROM runs"
o.table("lfeat", _features_of(
    _window_sql(_A_START, "w.ws - 1", _A_PRIOR, f"{_A_START} - 1", _L_ROWS)))
o.table("astat", "SELECT series_id, " + ", ".join(
    f"avg({f}) AS {f}_mu, stddev_samp({f}) AS {f}_sd" for f in an.ANCHOR_FEATURES)
    + " FROM afeat GROUP BY 1")
o.table("apairs", "SELECT r.run_id, r.series_id, r.today, k.label, k.window_end, k.january_only, sqrt("
        + " + ".join(f"pow(coalesce((l.{f} - {f}_mu) / nullif({f}_sd, 0), 0)"
                     f" - coalesce((a.{f} - {f}_mu) / nullif({f}_sd, 0), 0), 2)"
                     for f in an.ANCHOR_FEATURES)
        + """) AS distance FROM runs r JOIN lfeat l ON l.window_id = r.run_id
JOIN astat s ON s.series_id = r.series_id JOIN anchors k ON k.channel = r.series_id
JOIN afeat a ON a.window_id = k.label""")


def _lookup_sql(january: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
      round(distance, 9), abs(window_end - (today - 1)), label) AS rn
      FROM apairs WHERE january_only = ({january})) WHERE rn = 1"""


_LIVE_JANUARY = ("(month(today - 1) = 1 OR month(CAST(today - INTERVAL 2 MONTH AS DATE)) = 1"
                 " OR month(today) = 1)")
plain("anchor_lookup", "run_id series_id label distance:6", _lookup_sql(_LIVE_JANUARY),
      lambda x: an.anchor_lookup(x.runs, x.anchors, x.funnel))
o.table("lk_jan", _lookup_sql("true"))
o.table("lk_other", _lookup_sql("false"))
plain("switch_dual_lookup", "run_id req_id:i month label distance:6",
      """SELECT m.run_id, m.req_id, m.month, coalesce(j.label, n.label) AS label,
        coalesce(j.distance, n.distance) AS distance
        FROM smonths m LEFT JOIN lk_jan j ON j.run_id = m.run_id AND month(m.month) = 1
        LEFT JOIN lk_other n ON n.run_id = m.run_id AND month(m.month) <> 1
        WHERE coalesce(j.label, n.label) IS NOT NULL""",
      lambda x: swi.switch_dual_lookup(x.runs, x.anchors, x.funnel, x.calendar))
o.table("wsu", """
SELECT w.run_id, a.label, """ + ", ".join(f"a.{p}" for p in PARAM_NAMES) + """ FROM (
  SELECT w.run_id, a.label, row_number() OVER (PARTITION BY w.run_id
    ORDER BY abs(a.window_start - w.target_start), a.window_start) AS rn
  FROM an_top m JOIN (SELECT run_id, series_id, target_start, rank FROM an_top) w
    ON w.run_id = m.run_id AND w.rank = m.rank AND w.rank = 1
  JOIN anchors a ON a.channel = w.series_id) w JOIN anchors a ON a.label = w.label WHERE rn = 1""")
plain("warm_start_params", "run_id " + " ".join(f"{p}:4" for p in PARAM_NAMES),
      "SELECT * FROM wsu",
      lambda x: sw.warm_start_params(
          af.find_analogs(x.index, x.runs, 1, 14), x.anchors))

# ------------------------------------------------------------ indicators, regimes, study

plain("monthly_indicators_mtd", MTD, "SELECT * FROM mtd", lambda x: x.mtd)
plain("monthly_indicators_full",
      "series_id month application_count:2 approval_events:2 underwriting_submission_events:2 "
      "effective_biz_days:2 application_count_per_bizday:6 approval_events_per_bizday:6 "
      "underwriting_submission_events_per_bizday:6 approval_events_per_bizday_growth_1m:6 "
      "underwriting_submission_events_per_bizday_growth_1m:6",
      "SELECT * FROM mfull", lambda x: ind.monthly_indicators_full(_funnel_stream(x)))
plain("monthly_indicators_wide", "series_id month " + " ".join(f"{c}:5" for c in ind.INDICATORS),
      "SELECT * FROM mwide", lambda x: ind.monthly_indicators_wide(_funnel_stream(x)))
plain("growth_ladder", "series_id month indicator value:5", "SELECT * FROM ladder",
      lambda x: x.ladder)
plain("regime_weighted", "series_id month composite:6 regime",
      f"""SELECT *, CASE WHEN month(month) = 1 THEN 'January' WHEN composite >=
        {rg.WEIGHTED_THRESHOLD} THEN 'Regime2' ELSE 'Regime1' END AS regime
        FROM (SELECT *, {o.WEIGHTED_SQL} AS composite FROM mtd)""",
      lambda x: x.mtd.withColumn("composite", rg.weighted_composite()).withColumn(
          "regime", rg.regime_label(F.month("month"), F.col("composite"), rg.WEIGHTED_THRESHOLD)))
plain("regime_equal", "series_id month composite:6 regime",
      f"""SELECT *, CASE WHEN month(month) = 1 THEN 'January' WHEN composite >=
        {rg.EQUAL_THRESHOLD} THEN 'Regime2' ELSE 'Regime1' END AS regime
        FROM (SELECT *, {o.EQUAL_SQL} AS composite FROM mfull)""",
      lambda x: ind.monthly_indicators_full(_funnel_stream(x)).withColumn(
          "composite", rg.equal_composite()).withColumn(
          "regime", rg.regime_label(F.month("month"), F.col("composite"), rg.EQUAL_THRESHOLD)))
plain("regime_smoothing", SMOOTHED.replace("month ", ""),
      f"SELECT * FROM (SELECT *, {o.LATEST} AS rn FROM mrun_s) WHERE rn = 1",
      lambda x: rg.run_indicators(x.funnel, x.runs).withColumnRenamed("run_id", "series_id"))
plain("lead_lag_join", "series_id lead:i indicator month indicator_month value:5 regime_numeric:2",
      "SELECT * FROM ladder_led",
      lambda x: sy.lead_lag_join(x.optimal, x.ladder))
plain("correlation_sweep", CORR + " abs_corr:3", "SELECT * FROM corrs", lambda x: x.correlations)
_CAL_HIT = " OR ".join(f"contains(indicator, '{w}')" for w in sy.CALENDAR_WORDS)
_RANK = "row_number() OVER (PARTITION BY series_id ORDER BY abs_corr DESC, lead, indicator)"
REPORTS_SQL = f"""
SELECT 'regime' AS report, series_id, lead, indicator, correlation, n_obs FROM (
  SELECT *, {_RANK} AS rk FROM corrs WHERE param = 'regime_numeric') WHERE rk <= 25
UNION ALL SELECT 'calendar', series_id, lead, indicator, correlation, n_obs FROM corrs
  WHERE param = 'regime_numeric' AND ({_CAL_HIT})
UNION ALL SELECT 'per_bizday', series_id, lead, indicator, correlation, n_obs FROM (
  SELECT *, {_RANK} AS rk FROM corrs WHERE param = 'regime_numeric'
    AND contains(indicator, 'per_bizday')) WHERE rk <= 15"""


@query("correlation_reports", "report series_id lead:i indicator correlation:3 n_obs:i",
       REPORTS_SQL)
def _(x: Inputs) -> DataFrame:
    corr = stage(x.correlations, "correlations")
    parts = {"regime": sy.regime_top(corr, 25), "calendar": sy.calendar_subset(corr),
             "per_bizday": sy.per_bizday_subset(corr, 15)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("report"), "series_id", "lead", "indicator",
                           "correlation", "n_obs")
        out = part if out is None else out.unionByName(part)
    return out


plain("correlation_pivot",
      "series_id indicator lead_0m:3 lead_1m:3 lead_2m:3 lead_3m:3 max_abs:3",
      """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id
        ORDER BY max_abs DESC, indicator) AS rk FROM (
        SELECT *, greatest(abs(lead_0m), abs(lead_1m), abs(lead_2m), abs(lead_3m)) AS max_abs
        FROM (SELECT series_id, indicator, """ + ", ".join(
          f"avg(correlation) FILTER (lead = {k}) AS lead_{k}m" for k in sy.LEADS) + """
          FROM corrs WHERE param = 'regime_numeric' GROUP BY 1, 2))) WHERE rk <= 25""",
      lambda x: sy.correlation_pivot(x.correlations))
plain("composite_zscore", "series_id period regime composite_score:6", "SELECT * FROM scored",
      lambda x: x.scored)
plain("composite_correlation", "series_id r:6 n:i",
      """SELECT series_id, covar_samp(composite_score, regime_numeric)
        / nullif(stddev_samp(composite_score) * stddev_samp(regime_numeric), 0) AS r,
        count(*) AS n FROM scored GROUP BY 1""",
      lambda x: sy.composite_correlation(x.scored))
plain("threshold_scan", "series_id threshold:2 accuracy:6 correct:i total:i",
      "SELECT * FROM tscan", lambda x: sy.threshold_scan(x.scored))
plain("best_threshold", "series_id threshold:2 accuracy:6", "SELECT * FROM tbest",
      lambda x: sy.best_threshold(sy.threshold_scan(x.scored)))
plain("classification_table", "series_id period regime predicted_regime composite_score:6",
      "SELECT * FROM classified", _classified)

# ------------------------------------------------------------ structural fits

FORECAST = "run_id param_id:i day forecast:2"


def _per_model(sql: str) -> str:
    """The SQL once per model, with its prefix as {p} and its name as a column."""
    return " UNION ALL ".join(
        f"SELECT '{spec.name}' AS model, z.* FROM ({sql.format(p=p)}) z" for p, spec in o.SPECS.items())


def _each_model(part: Callable[[st.ModelSpec], DataFrame]) -> DataFrame:
    out = None
    for spec in o.SPECS.values():
        rows = part(spec).withColumn("model", F.lit(spec.name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


plain("fit_masks", "model run_id day prod in_halo seasonal",
      " UNION ALL ".join(
          f"""SELECT '{spec.name}' AS model, t.run_id, t.day, t.prod,
            {f't.day IN (SELECT d FROM {p}_halo)' if spec.exclude_halo else 'false'} AS in_halo,
            s.day IS NOT NULL AS seasonal FROM {p}_tr t
            LEFT JOIN {p}_se s ON s.run_id = t.run_id AND s.day = t.day WHERE t.dow < 5"""
          for p, spec in o.SPECS.items()),
      lambda x: _each_model(x.train))
plain("fit_trend", "model run_id intercept:8 slope:10", _per_model("SELECT * FROM {p}_tre"),
      lambda x: _each_model(lambda s: st.fit_trend(x.train(s), st.default_fits(x.runs, s))))


def _level(x: Inputs, spec: st.ModelSpec) -> DataFrame:
    fits = st.default_fits(x.runs, spec)
    train = stage(x.train(spec), "train")
    return st.fit_base_level(train, st.fit_trend(train, fits), fits, spec)


plain("fit_base_level", "model run_id base_level:8 n_train:i", _per_model("SELECT * FROM {p}_lev"),
      lambda x: _each_model(lambda s: _level(x, s)))
plain("fit_base_level_ranked", "run_id base_level:8 n_train:i", "SELECT * FROM mr_lev",
      lambda x: _level(x, st.MODEL_R))
plain("fit_dow_effect", "model run_id k:i e:8",
      " UNION ALL ".join(f"SELECT '{s.name}' AS model, run_id, dow AS k, e FROM {p}_dow"
                         for p, s in o.SPECS.items()),
      lambda x: _effect_union(x, "dow_effect"))
plain("fit_dom_effect", "model run_id k:i e:8",
      " UNION ALL ".join(f"SELECT '{s.name}' AS model, run_id, dom AS k, e FROM {p}_dom"
                         for p, s in o.SPECS.items() if s.use_dom),
      lambda x: _effect_union(x, "dom_effect"))
plain("fit_moy_effect", "model run_id k:i e:8",
      " UNION ALL ".join(f"SELECT '{s.name}' AS model, run_id, moy AS k, e FROM {p}_moy"
                         for p, s in o.SPECS.items() if s.use_moy),
      lambda x: _effect_union(x, "moy_effect"))
USES = {"dow_effect": lambda s: True, "dom_effect": lambda s: s.use_dom,
        "moy_effect": lambda s: s.use_moy}


def _effect_union(x: Inputs, column: str) -> DataFrame:
    out = None
    for spec in o.SPECS.values():
        if not USES[column](spec):
            continue
        part = _effect_rows(x.steps(spec)[2], column).withColumn("model", F.lit(spec.name))
        out = part if out is None else out.unionByName(part)
    return out


def _interactions(x: Inputs, spec: st.ModelSpec) -> DataFrame:
    _, fits, effects = x.steps(spec)
    rows = effects.join(fits.select("run_id", "interaction_shrinkage"), "run_id").select(
        "run_id", "interaction_shrinkage", F.explode("int_ratio").alias("k", "r"))
    s = F.col("interaction_shrinkage")
    return rows.select(
        "run_id", F.floor(F.col("k") / st.MOY_SLOTS).alias("dow"),
        (F.col("k") % st.MOY_SLOTS).alias("moy"), ((1 - s) * F.col("r") + s).alias("e"))


plain("fit_interaction", "model run_id dow:i moy:i e:8", _per_model("SELECT * FROM {p}_int"),
      lambda x: _each_model(lambda s: _interactions(x, s)))


plain("fit_effects", "run_id k:i e:8",
      "SELECT run_id, dow * 13 + moy AS k, (e - 0.35) / 0.65 AS e FROM ma_int",
      lambda x: _effect_rows(x.steps(st.MODEL_A)[2], "int_ratio"))


def _expected(x: Inputs, spec: st.ModelSpec) -> DataFrame:
    train, fits, effects = x.steps(spec)
    return st.expected_baseline(train, effects, fits, spec)


plain("expected_baseline", "model run_id day expected:2",
      _per_model("SELECT run_id, day, expected FROM {p}_ex WHERE dow < 5"),
      lambda x: _each_model(lambda s: _expected(x, s)))


plain("holiday_halo", "series_id day amount:2",
      "SELECT * FROM history WHERE day IN (SELECT d FROM mb_halo)",
      lambda x: x.history.join(
          F.broadcast(st.holiday_halo(st.holiday_days(x.calendar), 2, 4)), "day", "left_semi"))


def _distortion(x: Inputs, spec: st.ModelSpec, stepwise: bool = False) -> DataFrame:
    train, fits, effects = x.steps(spec)
    near = st.holiday_neighbours_stepwise(train, x.calendar, spec) if stepwise else None
    return st.fit_holiday_distortion(train, effects, fits, spec, near)


DISTORTION = "run_id holiday_dow:i biz_offset:i median_ratio:8 n_obs:i factor:8"
for _key, _p, _spec in (("fit_holiday_distortion", "ma", st.MODEL_A),
                        ("fit_holiday_distortion_b", "mb", st.MODEL_B),
                        ("fit_holiday_distortion_c", "mc", st.MODEL_C)):
    plain(_key, DISTORTION, f"SELECT * FROM {_p}_dis",
          lambda x, s=_spec: _distortion(x, s).withColumnRenamed("offset", "biz_offset"))
plain("fit_holiday_distortion_stepwise", DISTORTION,
      """SELECT run_id, holiday_dow, biz_offset, median(ratio) AS median_ratio, count(*) AS n_obs,
        0.7 * median(ratio) + 0.3 AS factor FROM mastep GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
      lambda x: _distortion(x, st.MODEL_A, True).withColumnRenamed("offset", "biz_offset"))
plain("fit_cliff_ratio", "run_id cliff_ratio:8", "SELECT * FROM mc_cl",
      lambda x: st.fit_cliff_ratio(x.train(st.MODEL_C), st.MODEL_C))
plain("fit_monthly_totals", "run_id month total:2", "SELECT * FROM mbm_mt",
      lambda x: st.fit_monthly_totals(x.history, x.runs))
plain("mom_trend_weight", "run_id month weight:8", "SELECT * FROM mbm_mom",
      lambda x: fo.mom_trend_weight(
          st.fit_monthly_totals(x.history, x.runs), fo.horizon_requests(x.runs, 2), o.MODEL_B_MOM))
plain("forecast_mom_trend", FORECAST, "SELECT * FROM mbm_fc",
      lambda x: x.forecast(o.MODEL_B_MOM))


@query("fit_woy_cliff_table", "run_id woy:i dow:i median_ratio:8 n_obs:i factor:8",
       "SELECT * FROM mrw_woy")
def _(x: Inputs) -> DataFrame:
    train, fits, effects = x.steps(o.MODEL_R_WOY)
    return st.fit_woy_cliff(train, effects, fits, o.MODEL_R_WOY)


# ------------------------------------------------------------ forecasts

plain("forecast_horizon", "run_id day h:i", "SELECT run_id, day, h FROM ma_hz",
      lambda x: fo.forecast_horizon(fo.horizon_requests(x.runs, 2)))
plain("forecast_seasonal", "run_id day seasonal:8",
      "SELECT run_id, day, sn AS seasonal FROM mr_fc", lambda x: x.forecast(st.MODEL_R))
plain("forecast_zero_rules", "run_id day is_holiday",
      "SELECT run_id, day, is_holiday FROM ma_fc WHERE forecast = 0",
      lambda x: x.forecast(st.MODEL_A).filter("forecast = 0"))
plain("forecast_distortion", "run_id day slot:i",
      "SELECT run_id, day, holiday_dow * 7 + biz_offset + 2 AS slot FROM ma_hk",
      lambda x: fo.horizon_distortion_keys(
          fo.forecast_horizon(fo.horizon_requests(x.runs, 2)), x.calendar, st.MODEL_A))
for _key, _p, _spec in (
    ("model_a", "ma", st.MODEL_A), ("model_b", "mb", st.MODEL_B),
    ("model_c", "mc", st.MODEL_C), ("model_r", "mr", st.MODEL_R),
    ("forecast_mon_thu_override", "mbo", o.MODEL_B_OVERRIDE),
    ("forecast_woy_cliff", "mrw", o.MODEL_R_WOY),
    ("train_month_exclusion", "mae", o.MODEL_A_EXCLUDE),
):
    plain(_key, FORECAST, f"SELECT * FROM {_p}_fc", lambda x, s=_spec: x.forecast(s))
plain("forecast_cliff", FORECAST,
      "SELECT * FROM mc_fc WHERE month(day) = 12 AND day(day) > 18",
      lambda x: x.forecast(st.MODEL_C).filter("month(day) = 12 and day(day) > 18"))
plain("target_scale", "run_id day y:6", "SELECT run_id, day, y FROM mr_pr",
      lambda x: x.train(st.MODEL_R).filter("prod"))
SWITCH = "run_id day forecast:2 model_used n_biz_days:i"
plain("switch_bizday", SWITCH, "SELECT * FROM switchb",
      lambda x: swi.switch_bizday(x.history, x.runs, x.calendar))
plain("switch_regime", SWITCH, "SELECT * FROM switchr",
      lambda x: swi.switch_regime(x.history, x.funnel, x.runs, x.calendar))

# ------------------------------------------------------------ tuning

plain("param_sweep_monthly", BEST, "SELECT * FROM wm_best", lambda x: x.month_best)
plain("param_sweep_window", BEST, "SELECT * FROM ww_best",
      lambda x: sw.param_sweep(
          x.history,
          sw.mid_month_windows(
              x.series, dt.date.fromisoformat(o.WINDOW_START), b.TRAIN_START),
          sw.WINDOW_GRID, x.calendar, st.MODEL_A, 2))
plain("param_search_ranges", BEST, "SELECT * FROM ws_best",
      lambda x: sw.search_params(x.history, x.month_windows, x.calendar, st.MODEL_R, o.TRIALS))
plain("param_override", "run_id param_id:i recency_strength:8 forward_lift_daily:8",
      "SELECT * REPLACE (0.0 AS forward_lift_daily) FROM ws_fits",
      lambda x: sw.param_override(sw.param_search_ranges(x.month_windows, o.TRIALS)))
plain("tuning_summary", f"series_id {BANDS}",
      _bands_sql("wm_best x JOIN wm_runs w ON w.run_id = x.run_id", "abs_pct_err", "series_id"),
      lambda x: ev.within_bands(
          x.month_best.join(x.month_windows.select("run_id", "series_id"), "run_id"),
          "abs_pct_err", "series_id"))

# ------------------------------------------------------------ analog forecast, reports


def _analog(x: Inputs) -> af.AnalogForecast:
    x.prepare()
    return af.analog_forecast(
        x.history, x.index, x.runs, x.calendar, b.TRAIN_START, n_trials=o.TRIALS,
        anchors=x.anchors)


plain("analog_forecast", "run_id day forecast:2 model_used",
      """SELECT f.run_id, f.day, f.forecast, 'analog_k3' AS model_used FROM af_blend f
        JOIN runs r ON r.run_id = f.run_id
        WHERE f.day BETWEEN r.forecast_start AND r.forecast_end
        UNION ALL SELECT run_id, NULL, NULL, 'none' FROM runs
        WHERE run_id NOT IN (SELECT run_id FROM af_blend)""",
      lambda x: af.cut_to_horizon(_analog(x).blended, x.runs, 3))
EVAL = "run_id series_id day source model_used actual:2 forecast:2 diff:2 pct_err:6"
plain("eval_frame", EVAL, "SELECT * FROM evi",
      lambda x: ev.eval_frame(x.history, x.labelled(st.MODEL_R), x.runs, "inner"))
plain("eval_frame_left", EVAL, "SELECT * FROM evl",
      lambda x: ev.eval_frame(x.history, x.labelled(st.MODEL_R), x.runs, "left"))
plain("report_frame", "run_id row_type day source actual:2 forecast:2 diff:2 pct_err:6",
      """SELECT run_id, 'day' AS row_type, day, source, actual, forecast, diff, pct_err FROM rrows
        UNION ALL SELECT run_id, 'TOTAL', NULL, 'forecast only', total_actual, total_forecast,
          total_forecast - total_actual, (total_forecast - total_actual) / total_actual * 100
          FROM rtotals
        UNION ALL SELECT run_id, 'MAE', NULL, NULL, NULL, mae, NULL, NULL FROM rtotals
        UNION ALL SELECT run_id, 'MAPE', NULL, NULL, NULL, mape, NULL, NULL FROM rtotals""",
      lambda x: ev.report_frame(
          x.history, ev.eval_frame(x.history, x.labelled(st.MODEL_R), x.runs), x.runs))
plain("month_end_view",
      "run_id day amount:2 source actual_total:2 forecast_total:2 grand_total:2",
      """SELECT *, sum(amount) FILTER (source = 'actual') OVER (PARTITION BY run_id) AS actual_total,
        sum(amount) FILTER (source = 'forecast') OVER (PARTITION BY run_id) AS forecast_total,
        sum(amount) OVER (PARTITION BY run_id) AS grand_total
        FROM (SELECT r.run_id, h.day, h.amount, 'actual' AS source FROM runs r JOIN history h
            ON h.series_id = r.series_id AND h.day BETWEEN r.today AND r.known_through
            WHERE isodow(h.day) < 6 AND h.amount > 0 AND h.day <= last_day(r.today)
          UNION ALL SELECT f.run_id, f.day, f.forecast, 'forecast' FROM rfc f
            JOIN runs r ON r.run_id = f.run_id WHERE isodow(f.day) < 6 AND f.forecast > 0
              AND f.day BETWEEN r.today AND last_day(r.today))""",
      lambda x: ev.month_end_view(x.history, x.labelled(st.MODEL_R), x.runs))
plain("batch_backtest",
      "run_id range_start range_end actuals_through mean_tune_err:6 actuals_total:2 "
      "forecast_total:2 blended_total:2 difference:2 pct_difference:6",
      "SELECT * FROM bt_pct", lambda x: x.backtest())
plain("backtest_summary", f"series_id {BANDS} mean_tune_err:6",
      _bands_sql("bt_pct WHERE pct_difference IS NOT NULL", "pct_difference", "series_id").replace(
          "avg(0) AS zero", "avg(mean_tune_err) AS mean_tune_err"),
      lambda x: bt.backtest_summary(x.backtest(), "series_id"))

# ------------------------------------------------------------ registry

REGISTRY = "label channel window_start window_end january_only high_error_flag run_date abs_err:4"


def _incoming(x: Inputs) -> DataFrame:
    """A later tuning of the same windows: errors a fifth of the first and shifted."""
    later = (F.col("abs_err") * 0.2 + F.when(F.month("window_start") == 11, 0.06).otherwise(0))
    return x.anchors.withColumn("abs_err", later.cast("decimal(10,4)")).withColumn(
        "run_date", F.date_add("run_date", 30))


o.table("reg_in", """
SELECT * REPLACE (CAST(round(CAST(abs_err AS DOUBLE) * 0.2
    + CASE WHEN month(window_start) = 11 THEN 0.06 ELSE 0 END, 10) AS DECIMAL(10,4)) AS abs_err,
  run_date + 30 AS run_date) FROM anchors""")
o.table("reg_up", """
SELECT * EXCLUDE (rn, is_new) FROM (
  SELECT *, row_number() OVER (PARTITION BY channel, window_start, window_end
    ORDER BY abs_err, is_new, run_date DESC, label) AS rn
  FROM (SELECT *, 0 AS is_new FROM anchors UNION ALL
    SELECT * REPLACE (abs_err > 0.08 AS high_error_flag,
      month(window_start) = 1 OR month(window_end) = 1 AS january_only), 1 AS is_new
    FROM reg_in WHERE abs_err <= 0.15)) WHERE rn = 1""")


@query("registry_upsert", REGISTRY, "SELECT * FROM reg_up")
def _(x: Inputs) -> DataFrame:
    """The stored table after the first tuning and two upserts of the later one, read back."""
    path = f"{staging_root(x.spark)}/tidecast/{uuid.uuid4().hex}/registry"
    reg.store_registry(x.anchors, path)
    reg.upsert_registry(_incoming(x), path)
    return reg.upsert_registry(_incoming(x), path)


plain("registry_latest", REGISTRY,
      """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY run_date DESC, abs_err) AS rn FROM (
          SELECT * FROM anchors UNION ALL SELECT * FROM reg_in)) WHERE rn = 1""",
      lambda x: reg.registry_latest(x.anchors.unionByName(_incoming(x))))
