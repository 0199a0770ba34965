import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidecast.catalog import QUERIES
from tidecast.operators import calendar as c
from tidecast.operators import daily, funnel
from tidecast.schemas import LOANS, SNAPSHOTS, require

D = dt.date
TODAY = D(2024, 3, 8)
CUP = "North Credit Union Partners"


def loan(n, channel, funded, amount, app=None, sub=None, appr=None, repeat=0):
    return (n, channel, funded, Decimal(amount), app, sub, appr, repeat)


LOAN_ROWS = [
    loan(1, "Retail", D(2024, 3, 4), "100.00", D(2024, 3, 4)),
    loan(2, "Retail", D(2024, 3, 4), "50.00", D(2024, 3, 5)),
    loan(3, "Retail", D(2024, 3, 9), "70.00"),                      # a Saturday
    loan(4, "National CORR desk", D(2024, 2, 29), "10.00"),         # Feb 29, matched by any case
    loan(5, "corr two", D(2024, 3, 6), "20.00"),
    loan(6, CUP, D(2024, 3, 6), "999.00", D(2024, 3, 4)),
    loan(7, None, D(2024, 3, 6), "5.00", D(2024, 3, 4)),
    loan(8, "Retail", D(2018, 3, 6), "5.00"),                       # older than five years
    loan(9, "Retail", D(2024, 3, 13), "30.00"),                     # the third business day ahead
    loan(10, "Retail", D(2024, 3, 14), "31.00"),                    # one day too late
    loan(11, "Retail", None, "8.00", D(2024, 3, 5), D(2024, 3, 6), D(2024, 3, 7), 1),
    loan(12, "Retail", None, "40.00", D(2024, 3, 5), D(2024, 3, 5)),
    loan(12, "Retail", D(2024, 3, 6), "40.00", D(2024, 3, 5), D(2024, 3, 6)),  # second row
]
SNAPS = [
    (1, D(2024, 3, 4), "Retail", Decimal("101.00"), "0100"),
    (1, D(2024, 3, 5), "Retail", Decimal("101.00"), "0100"),
    (1, D(2024, 3, 5), "Retail", Decimal("103.00"), "0100"),
    (2, D(2024, 3, 5), "Retail", Decimal("0.00"), "0110"),       # excluded status
    (2, D(2024, 3, 6), "Retail", Decimal("0.00"), "0200"),
    (3, D(2024, 3, 9), "Retail", Decimal("9.00"), "0200"),       # a weekend file date
    (11, D(2024, 3, 5), "Retail", Decimal("8.00"), "0200"),      # repeat application
    (12, D(2024, 3, 5), "Retail", Decimal("40.00"), "0200"),
    (12, D(2024, 3, 6), "Retail", Decimal("40.00"), "12c4"),     # letter in the status
    (12, D(2024, 3, 7), "Retail", Decimal("40.00"), None),       # null status
    (99, D(2024, 3, 5), "Retail", Decimal("77.00"), "0200"),     # no such loan
]


def tables(spark):
    loans = spark.createDataFrame(LOAN_ROWS, LOANS)
    snaps = spark.createDataFrame(SNAPS, SNAPSHOTS)
    cal = c.calendar_dimension(spark, D(2018, 1, 1), D(2024, 12, 31))
    return loans, snaps, cal


def test_daily_history_edges(spark):
    loans, _, cal = tables(spark)
    rows = daily.daily_history(loans, cal, TODAY).collect()
    assert {r.channel for r in rows} == {"Retail", "Correspondent"}
    days = sorted({r.calendar_date for r in rows})
    assert days[0] == D(2019, 3, 8) and days[-1] == D(2024, 3, 13)
    assert len(rows) == 2 * len(days) == 2 * ((days[-1] - days[0]).days + 1)
    at = {(r.channel, r.calendar_date): r for r in rows}
    assert at["Retail", D(2024, 3, 4)].number_of_loans == 2
    assert at["Retail", D(2024, 3, 4)].total_loan_amount == 150.0
    assert at["Retail", D(2024, 3, 9)].number_of_loans == 0          # weekend is zero
    assert at["Correspondent", D(2024, 2, 29)].total_loan_amount == 10.0
    # March of the channel: 2 + 1 + 1 weekday loans, the Saturday does not count
    assert at["Retail", D(2024, 3, 4)].day_of_month_weight == 2 / 4
    assert at["Retail", D(2024, 3, 4)].week_weight == 3 / 4
    # one over the number of grouped days of that month of the year
    assert at["Retail", D(2024, 3, 4)].month_to_month_weight_loans == 1 / 4


def test_weights_sum_to_one(spark):
    loans, _, cal = tables(spark)
    per_day = daily.funded_per_day(loans, cal, TODAY)
    total = defaultdict(float)
    for r in daily.calendar_weights(per_day).collect():
        total[r.channel, r.funded_date.year, r.funded_date.month] += r.day_of_month_weight or 0
    assert all(abs(v - 1) < 1e-12 for v in total.values())


def test_funnel_counts_distinct_and_sums_rows(spark):
    loans, snaps, cal = tables(spark)
    rows = {(r.filedt, r.channel): r for r in funnel.funnel_daily(loans, snaps, cal).collect()}
    assert set(rows) == {(D(2024, 3, d), "Retail") for d in (4, 5, 6)}
    r = rows[D(2024, 3, 5), "Retail"]
    # loans 1 (two snapshots) and 12 (one snapshot, two loan rows)
    assert r.loan_count == 2
    assert r.loan_volume == Decimal("284.00")            # 101 + 103 + 2 x 40
    assert r.funded_loan_count == 2
    assert r.funded_loan_volume == Decimal("244.00")     # one of the two rows of 12 is funded
    assert r.underwriting_submission_count == 1
    # events count every loan of the day, whatever its status: 2, 11 and 12
    assert r.application_count == 3
    assert r.application_volume == Decimal("48.00")      # 0 + 8 + 40
    assert r.avg_application_loan_size == Decimal("16.00")
    assert r.pull_through_pct_count == Decimal("100.00")
    assert r.pull_through_pct_volume == Decimal("85.92")
    first = rows[D(2024, 3, 4), "Retail"]
    assert first.application_volume == Decimal("204.00")  # both distinct amounts of loan 1
    assert first.avg_approval_loan_size is None


def test_simple_events_count_rows(spark):
    loans, _, _ = tables(spark)
    got = {(r.dt, r.channel): r.application_count for r in funnel.event_counts_simple(loans).collect()}
    assert got[D(2024, 3, 5), "Retail"] == 4   # loan 12 counts twice


def test_a_hot_loan_stays_exact(spark):
    """Half of all snapshot rows belong to one loan that also has many loan rows."""
    loans = spark.createDataFrame(
        [loan(1, "Retail", D(2024, 3, 4), "1.00", D(2024, 3, 4)) for _ in range(50)]
        + [loan(n, "Retail", None, "1.00", D(2024, 3, 4)) for n in range(2, 30)], LOANS)
    snaps = spark.createDataFrame(
        [(1, D(2024, 3, 4), "Retail", Decimal("2.00"), "0200") for _ in range(400)]
        + [(n, D(2024, 3, 4), "Retail", Decimal("3.00"), "0200") for n in range(2, 30)], SNAPSHOTS)
    r = funnel.funnel_base(loans, snaps).first()
    assert r.loan_count == 29
    assert r.loan_volume == Decimal(400 * 50 * 2 + 28 * 3)
    e = funnel.event_counts(loans, snaps).first()
    assert e.application_count == 29 and e.application_volume == Decimal(2 + 28 * 3)


def test_counts_above_32_bits_stay_exact(spark):
    many = 3_000_000_000
    loans = funnel.reduced_loans(spark.createDataFrame(
        [loan(1, "Retail", D(2024, 3, 4), "1.00", D(2024, 3, 4))], LOANS)).withColumn("n_rows", F.lit(many))
    snaps = spark.createDataFrame([(1, D(2024, 3, 4), "Retail", Decimal("2.50"), "0200")], SNAPSHOTS)
    reduced = funnel.reduced_snapshots(snaps).withColumn("n_rows", F.lit(many))
    r = funnel.funnel_base(loans, reduced).first()
    assert r.loan_count == 1
    assert r.loan_volume == r.funded_loan_volume == Decimal("2.50") * many * many


def test_reduced_tables_give_the_same_funnel(spark):
    loans, snaps, _ = tables(spark)
    raw = funnel.funnel_base(loans, snaps)
    reduced = funnel.funnel_base(funnel.reduced_loans(loans), funnel.reduced_snapshots(snaps))
    assert sorted(raw.collect()) == sorted(reduced.collect())
    events = funnel.event_counts(loans, snaps)
    again = funnel.event_counts(funnel.reduced_loans(loans), funnel.reduced_snapshots(snaps))
    assert sorted(events.collect(), key=str) == sorted(again.collect(), key=str)


def events_by_hand(loan_rows, snap_rows):
    """Row by row: the loans of each (day, channel, kind) and the sum of their distinct amounts."""
    amounts = defaultdict(set)
    for n, _, _, amount, _ in snap_rows:
        if n is not None:
            amounts[n].add(amount)
    seen = defaultdict(set)
    for n, channel, _, _, *days, _ in loan_rows:
        for kind, day in zip(("application", "submission", "approval"), days, strict=True):
            if day and n in amounts:
                seen[day, channel, kind].add(n)
    out = {}
    for key, ns in seen.items():
        known = [a for n in ns for a in amounts[n] if a is not None]
        out[key] = (len(ns), sum(known) if known else None)
    return out


def random_loans(seed, n=400):
    rnd = random.Random(seed)

    def day():
        return rnd.choice([None, D(2024, 3, 4), D(2024, 3, 5), D(2024, 3, 6)])

    loan_rows, snap_rows = [], []
    for i in range(n):
        channel = rnd.choice(["Retail", "Wholesale", None])
        rows = [loan(i or None, channel, None, "1.00", day(), day(), day(), rnd.choice([0, 1]))]
        if i % 5 == 0:  # a further row, often with some of the same days
            rows.append(loan(i or None, rnd.choice([channel, "Retail"]), None, "2.00",
                             rows[0][4], day(), day()))
        loan_rows += rows * (3 if i % 7 == 0 else 1)
        for _ in range(rnd.choice([0, 1, 1, 3])):
            amount = rnd.choice([None, Decimal("10.00"), Decimal("0.00"), Decimal(i) / 4])
            snap_rows.append((i or None, D(2024, 3, 4), "Retail", amount, "0200"))
    return loan_rows, snap_rows


def test_events_of_repeated_loans_match_a_count_by_hand(spark):
    loan_rows, snap_rows = random_loans(5)
    got = {}
    for r in funnel.event_counts(spark.createDataFrame(loan_rows, LOANS),
                                 spark.createDataFrame(snap_rows, SNAPSHOTS)).collect():
        for kind, count, volume in (
                ("application", r.application_count, r.application_volume),
                ("submission", r.underwriting_submission_events, r.underwriting_submission_event_volume),
                ("approval", r.approval_events, r.approval_event_volume)):
            assert count or volume is None
            if count:
                got[r.dt, r.channel, kind] = (count, volume)
    assert got == events_by_hand(loan_rows, snap_rows)


def test_a_task_does_not_hold_an_entry_for_each_event_of_a_loan(spark):
    """Unpivoted events are three times the loans: no step groups or sorts them by the loan."""
    loans, snaps, _ = tables(spark)
    plan = funnel.event_counts(loans, snaps)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Generate explode" not in plan[len(above) + 1 :]
    assert not re.search(r"keys=\[[^]]*loan_number#", above)
    assert "Join" not in above and "Sort " not in above
    # loans with one row share an entry for each day, channel and kind
    single = spark.createDataFrame(
        [loan(n, "Retail", None, "1.00", D(2024, 3, 4)) for n in range(1, 301)]
        + [loan(301, "Retail", None, "1.00", D(2024, 3, 4), x) for x in (None, D(2024, 3, 5))], LOANS)
    amounts = spark.createDataFrame(
        [(n, D(2024, 3, 4), "Retail", Decimal("2.00"), "0200") for n in range(1, 302)], SNAPSHOTS)
    rows = funnel.event_groups(single, amounts).collect()
    assert sorted((r.kind, r.several or 0, r.n, r.amount) for r in rows) == [
        ("application", 0, 300, Decimal("600.00")), ("application", 301, 1, Decimal("2.00")),
        ("submission", 301, 1, Decimal("2.00"))]


@pytest.mark.parametrize("name, column, want", [("safe_ratio", "ratio", 0.33333333), ("safe_pct", "pct", 0.5)])
def test_ratios_of_events_hold_no_entry_for_each_event(spark, tmp_path, name, column, want):
    day, later = dt.datetime(2001, 3, 31), dt.datetime(2001, 4, 30)
    orders = [(1, 1, "F", 10.0, day, "2-HIGH")] + [
        (n, 1, "F", 10.0, later, "2-HIGH") for n in (2, 2, 3, 4)]  # applications a month before
    shipped = [(1, day), (2, day), (2, dt.datetime(2001, 4, 5))]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(shipped, "l_orderkey long, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    out = QUERIES[name].run(spark, str(tmp_path))
    assert {r.filedt: r[column] for r in out.collect()} == {D(2001, 3, 31): want, D(2001, 4, 30): 0.0}
    plan = out._jdf.queryExecution().toString()
    assert "kind#" in plan and not re.search(r"keys=\[[^]]*loan_number#[^]]*kind#", plan)


def test_series_add_up_the_names_of_a_channel(spark):
    loans = spark.createDataFrame(
        [loan(1, "National Corr", D(2024, 3, 4), "1.00", D(2024, 3, 4)),
         loan(2, "Correspondent", None, "1.00", D(2024, 3, 4))], LOANS)
    snaps = spark.createDataFrame(
        [(1, D(2024, 3, 4), "National Corr", Decimal("30.00"), "0200"),
         (2, D(2024, 3, 4), "Correspondent", Decimal("10.00"), "0200")], SNAPSHOTS)
    cal = tables(spark)[2]
    rows = funnel.funnel_series(funnel.funnel_daily(loans, snaps, cal)).collect()
    assert [(r.series_id, r.loan_count, r.loan_volume) for r in rows] == [("Correspondent", 2.0, 40.0)]
    assert rows[0].pull_through_pct_count == 50.0 and rows[0].pull_through_pct_volume == 75.0
    assert rows[0].application_count == 2.0 and rows[0].avg_application_loan_size == 20.0


def test_require_reports_missing_and_mistyped(spark):
    import pytest
    loans, _, _ = tables(spark)
    assert require(loans, LOANS).columns == LOANS.fieldNames()
    with pytest.raises(ValueError, match="missing"):
        require(loans.drop("channel"), LOANS)
    with pytest.raises(ValueError, match="loan_number"):
        require(loans.withColumn("loan_number", loans.loan_number.cast("string")), LOANS)
