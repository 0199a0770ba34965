import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.functions import numeric as fn
from tidecast.functions import predicates as fp
from tidecast.operators import evaluate as ev
from tidecast.operators import indicators as ind
from tidecast.operators import regime as rg
from tidecast.sources import readers, sinks
from tidecast.staging import stage, staging_root

D = dt.date


def test_channel_rules(spark):
    rows = spark.createDataFrame(
        [("Correspondent",), ("my corr",), ("A Credit Union Partners B",), (None,), ("Retail",)],
        "channel string")
    kept = rows.filter(fp.channel_kept(F.col("channel")))
    got = [r[0] for r in kept.select(fp.normalized_channel(F.col("channel"))).collect()]
    assert got == ["Correspondent", "Correspondent", "Retail"]


def test_status_rules(spark):
    rows = spark.createDataFrame([("0100",), ("0110",), ("12c4",), ("12C4",), (None,)], "s string")
    assert [r.s for r in rows.filter(fp.status_kept(F.col("s"))).collect()] == ["0100"]


def test_guards(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    out = rows.select(
        fn.safe_ratio(F.col("a"), F.col("b")).alias("r"),
        fn.safe_pct(F.col("a"), F.col("b")).alias("p"),
        fn.ratio_or_null(F.col("a"), F.col("b")).alias("n"),
        fn.pct_change(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    assert [r.r for r in out] == [0.0, 0.25, None]
    assert [r.p for r in out] == [0.0, -0.75, None]
    assert [r.n for r in out] == [None, 0.25, None]
    assert [r.c for r in out] == [None, -0.75, None]


def test_numeric_coerce(spark):
    rows = spark.createDataFrame([("1.5", "x"), ("bad", "y")], "v string, k string")
    assert [r.v for r in fn.numeric_coerce(rows, ["k"]).collect()] == [1.5, None]


def test_regime_composites(spark):
    row = spark.createDataFrame(
        [(0.08, None, -0.016, 175.93, -0.018)],
        "application_count_per_bizday_growth_1m double, "
        "application_count_per_bizday_growth_3m double, "
        "approval_events_per_bizday_growth_1m double, application_count_per_bizday double, "
        "underwriting_submission_events_per_bizday_growth_1m double")
    r = row.select(rg.weighted_composite().alias("w"), rg.equal_composite().alias("e")).first()
    assert r.w == pytest.approx(0.45) and r.e == pytest.approx(0.0)
    labels = spark.createDataFrame([(1, 9.0), (2, 0.25), (3, 0.24), (4, None)], "m int, c double")
    got = [x[0] for x in labels.select(
        rg.regime_label(F.col("m"), F.col("c"), rg.WEIGHTED_THRESHOLD)).collect()]
    assert got == ["January", "Regime2", "Regime1", "Regime1"]
    assert rg.regime_params(spark).count() == 3


def test_smoothing_needs_two_rows(spark):
    cols = ("application_count_per_bizday_growth_1m", "approval_events_per_bizday_growth_1m")
    rows = spark.createDataFrame(
        [("s", D(2024, 1, 1), None, 1.0), ("s", D(2024, 2, 1), 0.2, 3.0),
         ("s", D(2024, 3, 1), 0.4, 5.0)], f"series_id string, month date, {cols[0]} double, {cols[1]} double")
    got = ind.smooth_growth(rows).orderBy("month").collect()
    assert [r[cols[0]] for r in got] == [None, None, pytest.approx(0.3)]
    assert [r[cols[1]] for r in got] == [None, 2.0, 4.0]


def evaluation(spark):
    runs = spark.createDataFrame(
        [("r", "s", D(2024, 3, 4), D(2024, 3, 6), D(2024, 3, 12))],
        "run_id string, series_id string, today date, known_through date, output_through date")
    history = spark.createDataFrame(
        [("s", D(2024, 3, d), float(v)) for d, v in
         [(4, 10), (5, 0), (6, 30), (7, 40), (8, 0), (9, 0), (11, 60)]],
        "series_id string, day date, amount double")
    fc = spark.createDataFrame(
        [("r", D(2024, 3, d), float(v), "m") for d, v in
         [(6, 99), (7, 50), (8, 20), (9, 0), (11, 0), (12, 70)]],
        "run_id string, day date, forecast double, model_used string")
    return history, fc, runs


def test_eval_modes(spark):
    history, fc, runs = evaluation(spark)
    inner = {r.day.day: r for r in ev.eval_frame(history, fc, runs, "inner").collect()}
    assert set(inner) == {6, 7, 11}
    assert inner[6].source == "actual" and inner[6].forecast == 30 and inner[6].diff == 0
    assert inner[7].pct_err == pytest.approx(25.0)
    left = {r.day.day: r for r in ev.eval_frame(history, fc, runs, "left").collect()}
    assert set(left) == {6, 7, 8, 12}
    assert left[12].actual is None and left[12].diff is None and left[8].pct_err is None


def test_report_rows_and_summary(spark):
    history, fc, runs = evaluation(spark)
    ev_rows = ev.eval_frame(history, fc, runs, "left")
    rows = ev.report_frame(history, ev_rows, runs).collect()
    assert sorted(r.day.day for r in rows if r.row_type == "day") == [4, 6, 7, 8, 12]
    by = {r.row_type: r for r in rows if r.row_type != "day"}
    # the forecast total covers all forecast rows, the actual total only scored ones
    assert by["TOTAL"].forecast == 140 and by["TOTAL"].actual == 40
    assert by["MAE"].forecast == 10 and by["MAPE"].forecast == pytest.approx(25.0)


def test_month_end_view(spark):
    history, fc, runs = evaluation(spark)
    rows = ev.month_end_view(history, fc, runs).collect()
    assert {(r.day.day, r.source) for r in rows} == {
        (4, "actual"), (6, "actual"), (7, "forecast"), (8, "forecast"), (12, "forecast")}
    assert {r.grand_total for r in rows} == {180.0}


def test_staging_and_sinks(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "n")
    assert stage(df, "t").agg(F.sum("n")).first()[0] == 10
    assert staging_root(spark)
    sinks.write_results(df, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 5


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(Session())


def test_inline_labels(spark):
    rows = {r.period: r for r in readers.monthly_optimal_params(spark, -12).collect()}
    assert len(rows) == 14 and rows["2024-09"].regime_numeric == 1.5
    assert rows["2024-01"].actual_total_growth is None
