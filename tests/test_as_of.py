"""Lookups by day against the same computed for each run or window on its own, and their plans."""

import datetime as dt
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidecast.operators import analog as an
from tidecast.operators import indicators as ind
from tidecast.operators import regime as rg
from tidecast.staging import carried_days, stage

D = dt.date
COLUMNS = ["biz_day", *an.MEASURES.values(), "is_holiday", "is_company_holiday",
           "avg_application_loan_size", "avg_underwriting_submission_loan_size", "avg_approval_loan_size"]


def funnel(spark, series=("s", "t"), n=330, seed=1):
    """Weekdays with gaps of days and of two months, and one series that ends early."""
    rnd, rows = random.Random(seed), []
    for k, s in enumerate(series):
        for i in range(n // (k + 1)):
            d = D(2023, 1, 1) + dt.timedelta(days=i)
            if d.weekday() < 5 and rnd.random() < 0.9 and not D(2023, 5, 10) < d < D(2023, 7, 12):
                rows.append((s, d, 1.0, *[round(rnd.uniform(0, 9e6), 2) if c.endswith("volume") else float(rnd.randint(0, 40))
                                          for c in COLUMNS[1:7]], float(rnd.random() < 0.1), 0.0,
                             *[round(rnd.uniform(1, 500), 2) for _ in range(3)]))
    return spark.createDataFrame(rows, "series_id string, filedt date, " + ", ".join(f"{c} double" for c in COLUMNS))


def runs_of(spark, pairs):
    return spark.createDataFrame([(f"{s}@{i}", s, d) for i, (s, d) in enumerate(pairs)],
                                 "run_id string, series_id string, today date")


@contextmanager
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    """The keys of every join of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.findall(r"(\w+)#\d+ <?=", line) for line in plan.splitlines() if re.search(r"\bJoin\b", line)]


@pytest.mark.parametrize("smooth", [True, False])
def test_run_indicators_equal_a_replay_of_each_run(spark, smooth):
    f = funnel(spark)
    days = [D(2022, 12, 1), D(2023, 1, 2), D(2023, 1, 3), D(2023, 2, 1), D(2023, 3, 15), D(2023, 5, 1), D(2023, 6, 20),
            D(2023, 7, 13), D(2023, 8, 1), D(2023, 11, 27), D(2025, 3, 3)]
    runs = runs_of(spark, [(s, d) for s in ("s", "t", "none") for d in days])
    got = {r.run_id: r.asDict() for r in rg.run_indicators(f, runs, smooth).collect()}
    want = {}
    for r in runs.collect():
        monthly = ind.monthly_indicators_mtd(f.filter(F.col("series_id") == r.series_id), F.lit(r.today))
        rows = ind.latest_month(ind.smooth_growth(monthly) if smooth else monthly).collect()
        want |= {r.run_id: {**x.asDict(), "run_id": r.run_id} for x in rows}
    assert set(got) == set(want) and len(want) == 18
    for k, row in want.items():
        row.pop("series_id")
        assert got[k] == {c: pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for c, v in row.items()}


def test_runs_meet_indicators_by_day(spark):
    f = stage(funnel(spark), "funnel")
    runs = stage(runs_of(spark, [("s", D(2023, 2, 1) + dt.timedelta(days=i % 200)) for i in range(2000)]), "runs")
    with no_broadcast(spark):
        out = rg.run_indicators(f, runs)
        assert out.count() == 2000
        found = joins(out)
    assert found and all(len(keys) > 1 for keys in found)


def test_carried_days_hold_until_the_next_row(spark):
    rows = spark.createDataFrame([("s", D(2024, 1, 1), 1), ("s", D(2024, 1, 4), 2), ("s", D(2024, 1, 4), 2), ("t", D(2024, 2, 1), 3)],
                                 "series_id string, day date, v int")
    got = sorted((r.series_id, r.as_of.day, r.v) for r in carried_days(rows, "day", F.lit(D(2024, 1, 6))).collect())
    assert got == [("s", 1, 1), ("s", 2, 1), ("s", 3, 1), ("s", 4, 2), ("s", 5, 2), ("s", 6, 2), ("t", 1, 3)]


def test_window_sums_equal_sums_of_days(spark):
    f, rnd = funnel(spark), random.Random(3)
    spans = []
    for i in range(60):
        start = D(2022, 12, 1) + dt.timedelta(days=rnd.randrange(500))
        prior = start - dt.timedelta(days=rnd.randrange(1, 60))
        gap = rnd.choice([1, 1, 5])
        spans.append((f"w{i}", rnd.choice("stu"), start, start + dt.timedelta(days=rnd.randrange(-3, 70)), prior,
                      max(prior, start - dt.timedelta(days=gap))))
    windows = spark.createDataFrame(spans, "window_id string, series_id string, start date, end date, prior_start date, prior_end date")
    rows = [r.asDict() for r in f.collect()]
    got = {r.window_id: r for r in an._window_sums(f, windows, {"size": "avg_approval_loan_size"}).collect()}
    assert len(got) == 60
    for name, s, start, end, lo, hi in spans:
        own = [r for r in rows if r["series_id"] == s]
        for tag, a, b in (("c", start, end), ("p", lo, hi)):
            inside = [r for r in own if a <= r["filedt"] <= b]
            assert got[name][f"rows_{tag}"] == len(inside)
            for m, c in an.MEASURES.items():
                assert got[name][f"{m}_{tag}"] == pytest.approx(sum(r[c] for r in inside), rel=1e-12, abs=1e-9)
        inside = [r["avg_approval_loan_size"] for r in own if start <= r["filedt"] <= end]
        assert got[name]["size"] == pytest.approx(sum(inside) / len(inside) if inside else 0.0)


def test_a_window_meets_three_days(spark):
    windows = an.live_anchor_windows(runs_of(spark, [("s", D(2023, 9, 1)), ("s", D(2023, 10, 9))])).select(
        "window_id", "series_id", "start", "end", "prior_start", "prior_end")
    days = {d for r in windows.collect() for d in (r.prior_start - dt.timedelta(1), r.prior_end, r.start - dt.timedelta(1), r.end)}
    assert len(days) == 6
    with no_broadcast(spark):
        out = an.volume_features(stage(funnel(spark), "funnel"), stage(windows, "windows"))
        assert all(keys == ["series_id", "as_of"] for keys in joins(out))


def test_2000_runs_of_one_series_share_the_work_of_the_search(spark):
    f = funnel(spark, n=700)
    signatures = stage(an.two_window_signature(f, D(2024, 12, 31)), "signatures")
    candidates = stage(signatures.filter("weekday(origin) < 5").withColumns(
        {"target_start": F.col("origin"), "target_end": F.date_add("origin", 29)}), "candidates")
    days = [D(2023, 10, 2) + dt.timedelta(days=i) for i in range(400)]
    runs = stage(runs_of(spark, [("s", days[i % 400]) for i in range(2000)]), "runs")
    norm = stage(an.robust_norm_stats(candidates), "norm")
    with no_broadcast(spark):
        distances = an.analog_distance(an.analog_queries(signatures, runs, norm, "today"), candidates)
        out = an.analog_topk_min_gap(distances, 3, 14)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r.run_id, []).append((r.rank, r.origin))
    assert all(len(keys) > 1 for keys in joins(out))
    blocked = plan.index("block")
    assert "row_number" in plan[blocked:] and len(got) == 2000
    # without blocks the same runs find the same matches
    some = distances.filter(F.col("run_id").isin("s@0", "s@17", "s@1999")).drop("block")
    for r in an.analog_topk_min_gap(some, 3, 14).collect():
        assert (r.rank, r.origin) in got[r.run_id]


def test_no_more_than_the_reach_of_a_block_leaves_its_task(spark):
    rows = [("r", "s", i % 2, D(2020, 1, 1) + dt.timedelta(days=i), float(i % 97)) for i in range(1000)]
    distances = spark.createDataFrame(rows, "run_id string, series_id string, block int, origin date, distance double").withColumns(
        {"target_start": F.col("origin"), "target_end": F.col("origin")})
    got = [(r.rank, r.origin) for r in an.analog_topk_min_gap(distances, 4, 10).orderBy("rank").collect()]
    want = []
    for o, x in sorted(((r[3], r[4]) for r in rows), key=lambda p: (p[1], p[0])):
        if len(want) < 4 and all(abs((o - w).days) >= 10 for w in want):
            want.append(o)
    assert got == list(enumerate(want, 1))


def test_nearest_anchor_equals_all_pairs(spark):
    rnd = random.Random(5)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(300))
    anchors = [(f"a{i}", rnd.choice("st"), day(), rnd.random()) for i in range(30)]
    targets = [(f"r{i}", rnd.choice("stu"), day()) for i in range(200)] + [("r0", "s", D(2020, 1, 1)), ("r1", "s", D(2030, 1, 1))]
    got = an.nearest_anchor(
        spark.createDataFrame(targets, "run_id string, series_id string, target_start date"),
        spark.createDataFrame(anchors, "label string, channel string, window_start date, x double")).collect()
    want = {}
    for r, s, d in targets:
        pool = [(abs((w - d).days), w, label) for label, c, w, _ in anchors if c == s]
        if pool:
            want[r, s, d] = min(pool)[2]
    assert {(r.run_id, r.series_id, r.target_start): r.label for r in got} == want
    assert "window_end" not in got[0].asDict()


def test_dates_meet_anchors_on_one_line(spark):
    runs = stage(runs_of(spark, [("s", D(2024, 1, 1) + dt.timedelta(days=i % 90)) for i in range(2000)]), "runs")
    anchors = stage(spark.createDataFrame([(f"a{i}", "s", D(2023, 6, 1) + dt.timedelta(days=7 * i)) for i in range(40)],
                                          "label string, channel string, window_start date"), "anchors")
    with no_broadcast(spark):
        out = an.nearest_anchor(runs.withColumnRenamed("today", "target_start"), anchors)
        assert out.count() == 2000
        assert joins(out) == [["series_id", "target_start"]]
