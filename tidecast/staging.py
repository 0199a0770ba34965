"""Staged tables: cut lineage by writing a result to the cluster's shared folder.

A fit is a chain in which later steps read earlier ones several times. Staging
the few tables that are read more than once keeps the plans linear, and the
files (unlike cached blocks) survive the loss of executors. Reading them back as
parquet also gives the planner true sizes, so it broadcasts only what is small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
T = TypeVar("T")


_local_roots: dict[str, str] = {}
#: Folders that this process has written, by application.
_written: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidecast-")
    return _local_roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def new_folder(spark: SparkSession) -> str:
    """A folder below the shared one that nothing else uses."""
    path = f"{staging_root(spark)}/tidecast/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> int:
    """Delete all that this process has staged for the session's application; how many folders.

    For a job that is done: results that have not been consumed may still read staged tables.
    """
    folders = _written.pop(spark.sparkContext.applicationId, [])
    for path in folders:
        remove(spark, path)
    return len(folders)


def in_parallel(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """Results of independent steps whose jobs run side by side.

    Small staged tables leave most of a cluster idle; steps that do not read each other need
    not wait for each other.
    """
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return list(pool.map(lambda step: inheritable_thread_target(spark)(step)(), steps))


def salts(spark: SparkSession) -> int:
    """Into how many tasks the rows of one key may be split: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(spark: SparkSession, most: int = 64) -> int:
    """The same where every block costs a copy of the other side."""
    return min(salts(spark), most)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash a table that later unfolds into many rows over all shuffle partitions.

    Fitted parameter sets are few bytes but much work each; left to its size, such a
    table would end up in one task. Steps keyed by ``keys`` then need no exchange.
    The reversed key order keeps the planner from merging this exchange with an
    earlier one by the same keys, which would be coalesced by size again.
    """
    return df.repartition(salts(df.sparkSession), *reversed(keys))


def sharded(df: DataFrame, by: str) -> DataFrame:
    """Adds ``shard``, which splits the parameter rows of a run by one of their keys."""
    n = salts(df.sparkSession)
    return df.withColumn("shard", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))


def join_sharded(keyed: DataFrame, rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of a run with its parameter rows, in the tasks of (run, shard).

    ``shards`` holds the distinct (run_id, shard) in use. The rows of a run are copied to
    those before they meet the parameters, so no exchange by the run alone carries a row per
    parameter set.
    """
    copied = rows.join(shards.select("run_id", "shard").distinct(), "run_id")
    return keyed.join(copied, ["run_id", "shard"])


def join_salted(rows: DataFrame, one_each: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with the one row that ``one_each`` has for their key, where a key may be most of the rows.

    The rows of a key are dealt to as many tasks as there are salts, and its one row is copied to each.
    """
    n = blocks(rows.sparkSession)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    copies = one_each.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def days_of(runs: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """A row per run and day from ``start`` to ``end``, to meet a daily table by (series, day)
    instead of meeting a series' whole history. Runs whose span is empty have no row."""
    span = F.when(F.col(start) <= F.col(end), F.sequence(start, end))
    return runs.withColumn(day, F.explode(span))


def carried_days(rows: DataFrame, day: str, until: Column) -> DataFrame:
    """Every row on each day on which it is its series' last one, the latest up to ``until``.

    A lookup "as of a day" is then an equality of (series, day): no join by the series alone, and
    no more rows than the calendar has days. Of rows on one day the last in any order stays.
    """
    later = F.lead(day).over(Window.partitionBy("series_id").orderBy(day))
    last = F.coalesce(F.date_sub("_later", 1), F.greatest(F.col(day), until))
    span = F.when(F.col(day) <= last, F.sequence(day, last))
    return rows.withColumn("_later", later).withColumn("as_of", F.explode(span)).drop("_later")
