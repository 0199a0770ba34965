"""Results that are whole or absent, and a registry that is written back."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidecast import staging
from tidecast.operators import registry as reg
from tidecast.sources import sinks

D = dt.date
SCHEMA = ("label string, channel string, window_start date, window_end date, january_only boolean, "
          "high_error_flag boolean, run_date date, abs_err double")


def test_clean_up_deletes_what_was_staged(spark):
    staged = staging.stage(spark.range(3), "t")
    folder = os.path.dirname(staged.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    assert staging.clean_up(spark) >= 1 and not os.path.exists(os.path.dirname(folder))
    assert staging.clean_up(spark) == 0


def tuned(spark, *rows):
    return spark.createDataFrame(
        [(label, channel, D(2024, m, 1), D(2024, m, 28), False, False, D(2024, run, 1), err)
         for label, channel, m, run, err in rows], SCHEMA)


def files(path):
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet"))
            for d in os.listdir(path) if d.startswith("channel=")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_upserts_read_back_and_other_channels_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = tuned(spark, ("a", "007", 2, 3, 0.05), ("b", "x", 3, 4, 0.02), ("c", None, 4, 5, 0.07))
    assert rows(reg.upsert_registry(first, path)) == rows(first)
    before = files(path)
    second = tuned(spark, ("a2", "007", 2, 6, 0.01), ("a3", "007", 1, 6, 0.09), ("b2", "x", 3, 6, 0.2),
                   ("n", "new", 5, 6, 0.03))
    got = reg.upsert_registry(second, path)
    want = reg.registry_upsert(first, second)
    assert rows(got) == rows(want) and got.count() == 5
    after = files(path)
    untouched = {d for d in before if d != "channel=007"}
    assert len(untouched) == 2 and all(after[d] == before[d] for d in untouched)
    assert after["channel=007"] != before["channel=007"] and "channel=new" in after
    third = tuned(spark, ("c9", None, 4, 7, 0.01))
    assert rows(reg.upsert_registry(third, path)) == rows(reg.registry_upsert(want, third))


def test_an_upsert_without_accepted_rows_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = tuned(spark, ("a", "x", 2, 3, 0.05))
    reg.upsert_registry(first, path)
    before = files(path)
    assert rows(reg.upsert_registry(tuned(spark, ("z", "x", 2, 3, 0.5)), path)) == rows(first)
    assert rows(reg.upsert_registry(first.limit(0), path)) == rows(first)
    assert files(path) == before


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "results")
    with pytest.raises(FileNotFoundError):
        sinks.latest(spark, path)
    good = spark.range(20).withColumnRenamed("id", "n")
    first = sinks.publish(good, path)
    bad = spark.range(0, 1000, 1, 8).select(
        F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(bad, path)
    assert sinks.latest(spark, path) == first
    assert spark.read.parquet(sinks.latest(spark, path)).count() == 20
    second = sinks.publish(good.limit(3), path, "csv", ())
    assert sinks.latest(spark, path) == second != first
    assert spark.read.csv(second, header=True).count() == 3


def test_old_versions_go_and_failed_ones_with_them(spark, tmp_path):
    path = str(tmp_path / "results")
    one = spark.range(1)
    made = [sinks.publish(one, path) for _ in range(2)]
    os.mkdir(f"{path}/v0000000003-failed")
    made += [sinks.publish(one.withColumn("p", F.lit("x")), path, partition_by=("p",)) for _ in range(2)]
    left = {os.path.join(path, d) for d in os.listdir(path) if d.startswith("v")}
    assert left == set(made[2:])
    with pytest.raises(ValueError):
        sinks.publish(one, path, keep=0)
