"""Exact medians by counting against numpy, and one scan of the loans."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidecast.operators import calendar as c
from tidecast.operators import daily
from tidecast.operators import evaluate as ev
from tidecast.operators import selection as sel

D = dt.date


@pytest.mark.parametrize("accuracy", [2000, 20])
def test_medians_of_odd_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(sel, "ACCURACY", accuracy)
    rnd = random.Random(accuracy)
    groups = {
        "ties": [1.0] * 500 + [2.0] * 500, "one": [7.0], "two": [1.0, 2.0], "skew": [10.0**i for i in range(-200, 200)],
        "zeros": [0.0] * 900 + [rnd.random() for _ in range(99)], "normal": [rnd.gauss(0, 1) for _ in range(5001)],
        "infinite": [float("-inf"), 1.0, float("inf")], None: [rnd.random() for _ in range(1000)],
        "blocks": [0.0] * 300 + [1e9] * 300, "hot": [float(rnd.randrange(50)) for _ in range(20000)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("hot", None), ("empty", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: r.median for r in sel.exact_median(df, ["g"], F.col("x")).collect()}
    assert got == {g: pytest.approx(statistics.median(xs), rel=1e-12) for g, xs in groups.items()}
    whole = sel.exact_median(df.filter("g <> 'infinite'"), [], F.col("x")).first().median
    assert whole == pytest.approx(statistics.median([x for g, xs in groups.items() if g not in (None, "infinite") for x in xs]))
    assert sel.exact_median(df.limit(0), ["g"], F.col("x")).count() == 0


def test_a_large_group_leaves_no_large_task(spark):
    """Of ten million values few hundred distinct ones reach the task that picks the middle."""
    rows = spark.range(0, 10_000_000, 1, 16).select(
        F.lit("g").alias("g"), ((F.col("id") * 7919 % 9999991) / 16).alias("_v"))
    upto = sel._counted(rows, ["g"], 4.0 / sel.ACCURACY)
    assert upto.first().low is not None
    got = sel.exact_median(rows, ["g"], F.col("_v")).first().median
    want = rows.select(F.percentile("_v", 0.5)).first()[0]
    assert got == want
    ends = rows.agg(F.percentile_approx("_v", [0.498, 0.502], sel.ACCURACY)).first()[0]
    assert rows.filter(F.col("_v").between(*ends)).count() < 10_000_000 * 8 / sel.ACCURACY


def test_bands_keep_groups_without_errors(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", -7.0), ("b", None)], "k string, e double")
    got = {r.k: r for r in ev.within_bands(rows, "e", "k").collect()}
    assert (got["a"].n, got["a"].median_abs_err, got["a"].within_5) == (2, 4.0, 1)
    assert (got["b"].n, got["b"].median_abs_err, got["b"].within_5) == (0, None, 0)
    assert ev.within_bands(rows, "e").first().median_abs_err == 4.0


def test_daily_history_reads_its_loans_once(spark, tmp_path):
    cal = c.calendar_dimension(spark, D(2023, 1, 1), D(2024, 12, 31))
    loans = [(i, ["Retail", "old", "other"][i % 3], D(2024, 1, 1 + i % 28) if i % 3 else D(1990, 1, 1), 10.0) for i in range(900)]
    loans += [(-1, "undated", None, 5.0)]
    frame = spark.createDataFrame(loans, "loan_number long, channel string, funded_date date, loan_amount double")
    frame = frame.withColumn("loan_amount", F.col("loan_amount").cast("decimal(18,2)"))
    path = str(tmp_path / "loans")
    frame.write.parquet(path)
    out = daily.daily_history(spark.read.parquet(path), cal, D(2024, 6, 3))
    assert path not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(path not in f for f in out.inputFiles())
    per = {r.channel: r.n for r in out.groupBy("channel").agg(F.sum("number_of_loans").alias("n")).collect()}
    names = {r.channel for r in daily.channels(frame).collect()}
    assert set(per) == names and len(names) == 4
    assert sum(per.values()) == sum(1 for _, _, d, _ in loans if d and d.year == 2024 and d.weekday() < 5)
