"""Sinks: published results, partitioned tables and sorted reports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidecast.staging import remove

COMPLETE = "_COMPLETE"


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (),
            keep: int = 2) -> str:
    """Write a result as a new version below ``path`` and return the version's folder.

    A version counts only once its marker is there, which is set after the write has ended, so
    readers see a whole result or the one before; a failed write changes nothing. All but the
    last ``keep`` complete versions are then removed, along with failed ones older than those.
    """
    if keep < 1:
        raise ValueError("at least the new version stays")
    spark = df.sparkSession
    taken = [int(m[1]) for v in _versions(spark, path) if (m := re.match(r"v(\d+)-", v))]
    name = f"v{max(taken, default=0) + 1:010d}-{uuid.uuid4().hex[:8]}"
    write_results(df, f"{path}/{name}", fmt, "errorifexists", partition_by)
    fs, at = _folder(spark, f"{path}/{name}/{COMPLETE}")
    fs.create(at, True).close()
    known = _versions(spark, path)
    oldest_kept = sorted(v for v, complete in known.items() if complete)[-keep:][0]
    for v in known:
        if v < oldest_kept:
            remove(spark, f"{path}/{v}")
    return f"{path}/{name}"


def latest(spark: SparkSession, path: str) -> str:
    """Folder of the last complete version below ``path``."""
    complete = [v for v, done in _versions(spark, path).items() if done]
    if not complete:
        raise FileNotFoundError(f"no complete result below {path}")
    return f"{path}/{max(complete)}"


def _folder(spark: SparkSession, path: str):
    """File system and path as Spark sees them, wherever the folder is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> dict[str, bool]:
    """The versions below a folder and whether they are complete."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    marker = lambda v: _folder(spark, f"{path}/{v}/{COMPLETE}")[1]
    return {v: fs.exists(marker(v)) for v in names if re.match(r"v\d+-", v)}


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replace those partitions of a table that ``df`` has rows of; the others keep their files.

    ``df`` must not read the table's files; stage it first.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def sort_output(df: DataFrame, *keys: str) -> DataFrame:
    """Global order, only for a result that leaves the job."""
    return df.orderBy(*keys)
