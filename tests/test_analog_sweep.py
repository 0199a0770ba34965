import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidecast.operators import analog as an
from tidecast.operators import registry as reg
from tidecast.operators import study as sy
from tidecast.operators import sweep as sw
from tidecast.plans import analog_forecast as af
from tidecast.schemas import PARAM_NAMES

D = dt.date


def distances(spark, rows):
    return spark.createDataFrame(
        [(run, "s", o, o, o + dt.timedelta(days=29), d) for run, o, d in rows],
        "run_id string, series_id string, origin date, target_start date, target_end date, "
        "distance double")


def greedy(rows, k, gap):
    picked = []
    for distance, origin in sorted(rows):
        if len(picked) < k and all(abs((origin - o).days) >= gap for _, o in picked):
            picked.append((distance, origin))
    return picked


@pytest.mark.parametrize("k,gap", [(1, 1), (3, 14), (5, 30), (4, 1)])
def test_min_gap_matches_a_greedy_pass_with_ties(spark, k, gap):
    rnd = random.Random(4)
    runs = {}
    for r in range(12):
        at = rnd.sample(range(200), rnd.choice([3, 40, 200]))
        runs[f"r{r}"] = [(float(rnd.randint(0, 5)), D(2000, 1, 1) + dt.timedelta(days=d)) for d in at]
    rows = [(r, o, d) for r, pairs in runs.items() for d, o in pairs]
    got = {}
    for r in an.analog_topk_min_gap(distances(spark, rows).repartition(5), k, gap).collect():
        got.setdefault(r.run_id, []).append((r["rank"], r.distance, r.origin))
    assert {r: [x[1:] for x in sorted(v)] for r, v in got.items()} == {
        r: greedy(pairs, k, gap) for r, pairs in runs.items()}


def test_min_gap_is_greedy_and_complete(spark):
    import random
    rnd = random.Random(5)
    rows = [(run, D(2024, 1, 1) + dt.timedelta(days=i), round(rnd.random(), 2))
            for run in ("x", "y") for i in range(200)]
    got = {}
    for r in an.analog_topk_min_gap(distances(spark, rows), 4, 14).collect():
        got.setdefault(r.run_id, []).append((r["rank"], r.origin))
    for run in ("x", "y"):
        want = []
        for d, o in sorted((d, o) for k, o, d in rows if k == run):
            if len(want) < 4 and all(abs((o - w).days) >= 14 for w in want):
                want.append(o)
        assert [o for _, o in sorted(got[run])] == want


def funnel(spark, n=400):
    rows = []
    for i in range(n):
        d = D(2023, 1, 1) + dt.timedelta(days=i)
        if d.weekday() < 5:
            v = 10.0 + 5 * math.sin(i / 20)
            rows.append(("s", d, 1.0, v, v * 100, v + 1, v * 90, v + 2, v * 80))
    return spark.createDataFrame(
        rows, "series_id string, filedt date, biz_day double, application_count double, "
        "application_volume double, underwriting_submission_events double, "
        "underwriting_submission_event_volume double, approval_events double, "
        "approval_event_volume double")


def test_signature_frames_match_window_sums(spark):
    f = funnel(spark)
    origin = D(2023, 9, 13)
    sig = an.two_window_signature(f, D(2024, 2, 1)).filter(F.col("origin") == F.lit(origin)).first()
    for suffix, n in (("1m", 30), ("2m", 60)):
        w = spark.createDataFrame(
            [("w", "s", origin - dt.timedelta(days=n), origin - dt.timedelta(days=1),
              origin - dt.timedelta(days=2 * n), origin - dt.timedelta(days=n + 1))],
            "window_id string, series_id string, start date, end date, prior_start date, "
            "prior_end date")
        v = an.volume_features(f, w).first()
        for m in [*an.LEVELS, *an.CHANGES]:
            assert sig[f"{m}_{suffix}"] == pytest.approx(v[m], rel=1e-12)
        if n == 60:
            assert sig.biz_day_count_forecast == v.biz_day_count


def test_window_without_rows_is_all_zero(spark):
    w = spark.createDataFrame(
        [("w", "s", D(2030, 1, 1), D(2030, 1, 30), D(2029, 12, 1), D(2029, 12, 31))],
        "window_id string, series_id string, start date, end date, prior_start date, prior_end date")
    v = an.volume_features(funnel(spark, 30), w).first()
    assert all(v[m] == 0 for m in [*an.LEVELS, *an.CHANGES, "biz_day_count"])


def test_identical_window_has_distance_zero_and_lookahead_is_excluded(spark):
    f = funnel(spark)
    sig = an.two_window_signature(f, D(2024, 2, 1))
    cand = sig.filter(F.weekday("origin") < 5).withColumns(
        {"target_start": F.col("origin"), "target_end": F.date_add("origin", 29)})
    norm = an.robust_norm_stats(cand)
    runs = spark.createDataFrame([("r", "s", D(2023, 11, 1))],
                                 "run_id string, series_id string, forecast_start date")
    q = an.analog_queries(sig, runs, norm)
    d = an.analog_distance(q, cand)
    assert d.agg(F.max("target_end")).first()[0] < D(2023, 11, 1)
    # the same signature offered as a candidate that ended earlier
    twin = sig.filter(F.col("origin") == F.lit(D(2023, 11, 1))).withColumns(
        {"target_start": F.lit(D(2023, 6, 1)), "target_end": F.lit(D(2023, 6, 30))})
    assert an.analog_distance(q, twin).first().distance == 0


def test_weights_sum_to_one(spark):
    m = distances(spark, [("x", D(2024, 1, 1), 0.0), ("x", D(2024, 3, 1), 2.0),
                          ("y", D(2024, 1, 1), 5.0)]).withColumn("rank", F.lit(1))
    total = {r.run_id: r.w for r in
             af.match_weights(m).groupBy("run_id").agg(F.sum("weight").alias("w")).collect()}
    assert total == pytest.approx({"x": 1.0, "y": 1.0})


def test_grid_order_is_the_product_order(spark):
    from itertools import product
    runs = spark.createDataFrame([("r",)], "run_id string")
    got = {r.param_id: tuple(r[p] for p in PARAM_NAMES)
           for r in sw.expand_grid(runs, sw.MONTHLY_GRID).collect()}
    want = list(product(*[sw.MONTHLY_GRID[p] for p in PARAM_NAMES]))
    assert len(want) == 128 and [got[i] for i in range(128)] == want
    assert math.prod(len(v) for v in sw.WINDOW_GRID.values()) == 6561


def test_search_points_fill_their_ranges(spark):
    runs = spark.createDataFrame([("r",)], "run_id string")
    rows = sw.param_search_ranges(runs, 400).collect()
    for p, (lo, hi) in sw.SEARCH_RANGES.items():
        values = [r[p] for r in rows]
        assert lo <= min(values) and max(values) <= hi
        assert max(values) - min(values) > 0.97 * (hi - lo)
        thirds = [sum(lo + (hi - lo) * k / 3 <= v < lo + (hi - lo) * (k + 1) / 3 for v in values)
                  for k in range(3)]
        assert min(thirds) > 100
    assert {type(r.level_lookback_days) for r in rows} == {int}


def test_argmin_takes_the_first_of_ties(spark):
    scored = spark.createDataFrame(
        [("r", 3, 1.0, 1.0, 0.5, 0.5), ("r", 1, 1.0, 1.0, -0.5, 0.5), ("r", 2, 1.0, 1.0, 9.0, 9.0),
         ("r", 0, 1.0, 1.0, None, None)],
        "run_id string, param_id long, forecast_total double, actual_total double, "
        "signed_pct_err double, abs_pct_err double")
    scored = scored.withColumns({p: F.col("param_id") * 10 for p in PARAM_NAMES})
    best = sw.argmin_params(scored).collect()
    assert [(r.param_id, r.signed_pct_err, r.dow_shrinkage) for r in best] == [(1, -0.5, 10)]


def registry(spark, rows):
    return spark.createDataFrame(
        rows, "label string, channel string, window_start date, window_end date, "
        "january_only boolean, high_error_flag boolean, run_date date, abs_err double")


def test_registry_rules(spark):
    old = registry(spark, [
        ("a", "c", D(2024, 2, 1), D(2024, 2, 29), False, False, D(2024, 3, 1), 0.05),
        ("b", "c", D(2024, 3, 1), D(2024, 3, 31), False, False, D(2024, 4, 1), 0.01)])
    new = registry(spark, [
        ("a", "c", D(2024, 2, 1), D(2024, 2, 29), False, False, D(2024, 5, 1), 0.02),
        ("b", "c", D(2024, 3, 1), D(2024, 3, 31), False, False, D(2024, 5, 1), 0.03),
        ("d", "c", D(2024, 1, 15), D(2024, 2, 14), False, False, D(2024, 5, 1), 0.10),
        ("e", "c", D(2024, 6, 1), D(2024, 6, 30), False, False, D(2024, 5, 1), 0.16)])
    got = {r.label: r for r in reg.registry_upsert(old, new).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"].abs_err == 0.02 and got["b"].abs_err == 0.01
    assert got["d"].high_error_flag and got["d"].january_only
    latest = {r.label: r.run_date for r in reg.registry_latest(old.unionByName(new)).collect()}
    assert latest["b"] == D(2024, 5, 1)


def test_nearest_anchor_and_pools(spark):
    anchors = spark.createDataFrame(
        [("j", "s", D(2024, 1, 1)), ("f", "s", D(2024, 2, 1)), ("o", "t", D(2024, 2, 10))],
        "label string, channel string, window_start date")
    targets = spark.createDataFrame([("r", "s", D(2024, 2, 10))],
                                    "run_id string, series_id string, target_start date")
    assert an.nearest_anchor(targets, anchors).first().label == "f"


def test_threshold_scan_prefers_the_last_best(spark):
    rows = [("s", "Regime1", -0.4), ("s", "Regime2", 0.6), ("s", "Transition", 0.5),
            ("s", "January", 9.0), ("s", "Regime1", None)]
    scored = spark.createDataFrame(rows, "series_id string, regime string, composite_score double")
    scan = sy.threshold_scan(scored)
    assert scan.count() == 30
    best = sy.best_threshold(scan).first()
    assert best.threshold == pytest.approx(0.5) and best.accuracy == 1
