"""Exact medians of groups of any size, by counting.

``median`` holds all values of a group in one task. Here approximate quantiles, which merge
from partial sketches, give a narrow range of values around the middle; one counting pass then
says how many values lie below it and how often each value inside it occurs. The middle
ranks are read off those counts, so the result is exact, ties included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.staging import blocks, stage

ACCURACY = 2_000


def _counted(rows: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """``keys, n, low, high``: the values at the two middle ranks, null if the range missed one."""
    ends = F.percentile_approx("_v", [max(0.5 - margin, 0.0), min(0.5 + margin, 1.0)], ACCURACY)
    ranges = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(
        F.count("_v").alias("n"), ends.alias("ends"))
    # the rows of a group meet its range in many tasks
    n_salts = blocks(rows.sparkSession)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(n_salts)).cast("int"))
    copies = ranges.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    own = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    met = salted.join(copies, reduce(Column.__and__, own, F.col("_salt") == F.col("_copy")))
    inside = F.when(F.col("_v") >= F.col("ends")[0], F.col("_v"))  # null: below the range
    counts = met.filter(F.col("_v") <= F.col("ends")[1]).groupBy(*keys, "n", inside.alias("_v")).agg(
        F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    total = counts.withColumn("upto", F.sum("c").over(upto))

    def at(rank: Column) -> Column:
        here = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
        return F.max(F.when(here, F.col("_v")))

    return total.groupBy(*keys, "n").agg(
        at(F.floor((F.col("n") - 1) / 2)).alias("low"), at(F.floor(F.col("n") / 2)).alias("high"))


def exact_median(rows: DataFrame, keys: list[str], value: Column, name: str = "median") -> DataFrame:
    """``keys`` and the median of the values that are not null; groups without one have no row.

    ``rows`` is read twice, and once more for groups whose range has missed the middle.
    """
    rows = rows.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    margin, done = 4.0 / ACCURACY, []
    while True:
        found = stage(_counted(rows, keys, margin), "medians")
        missed = found.filter("low IS NULL OR high IS NULL")
        done.append(found.filter("low IS NOT NULL AND high IS NOT NULL"))
        if margin >= 0.5 or missed.isEmpty():  # the last range holds all values
            break
        if keys:
            again = missed.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
            own = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
            rows = rows.join(again, reduce(Column.__and__, own), "left_semi")
        margin *= 8
    return reduce(DataFrame.unionByName, done).select(
        *keys, (0.5 * F.col("low") + 0.5 * F.col("high")).alias(name))
