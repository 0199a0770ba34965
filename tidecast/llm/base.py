"""What all operators share: reading, bucket numbers, code for the tasks, the held-out split."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidecast
from tidecast.staging import stage


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package wherever it was started.

    On a cluster submit the package with ``--py-files`` or install it.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(tidecast.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def _give_back() -> None:
    """Return freed memory to the system; Python workers are kept and would sit on it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """A function for ``mapInArrow`` or ``applyInArrow`` that ends by giving memory back."""
    if inspect.isgeneratorfunction(function):
        def batches(rows):
            yield from function(rows)
            _give_back()
        return batches
    if function.__code__.co_argcount == 2:
        def pair(left, right):
            out = function(left, right)
            _give_back()
            return out
        return pair

    def group(table):
        out = function(table)
        _give_back()
        return out
    return group


def keyed_tidy(function: Callable) -> Callable:
    """``tidy`` for a function of a key and two tables."""
    def pair(key, left, right):
        out = function(key, left, right)
        _give_back()
        return out
    return pair


def repeated(df: DataFrame, times: str, index: str = "_copy", block: int = 4096) -> DataFrame:
    """Each row as often as its number ``times`` says, numbered from 0 by ``index``.

    Rows with many copies are first cut into blocks that are dealt out, so that no task
    writes all copies of a row. ``df`` is read twice.
    """
    n = F.col(times)
    upto = lambda first, last, step: F.explode(F.sequence(first, last, F.lit(step).cast("long")))
    zero = F.lit(0).cast("long")
    few = df.filter((n > 0) & (n <= block)).withColumn(index, upto(zero, n - 1, 1))
    many = df.filter(n > block).withColumn("_first", upto(zero, n - 1, block))
    many = many.repartition(F.xxhash64(times, "_first")).withColumn(
        index, upto(F.col("_first"), F.least(n, F.col("_first") + block) - 1, 1)).drop("_first")
    return few.unionByName(many)


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under names of ours."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def buckets(n_bytes: int, each: int) -> int:
    """Enough hash buckets that each gets about ``each`` bytes; they grow with the data alone."""
    return max(-(-n_bytes // each), 1)


def chunk_bytes(n_bytes: int) -> int:
    """Size of a chunk of documents: 4 MB, more for large data, up to 64 MB.

    Chunks and buckets exchange a row per pair, so both must not grow in number alone.
    """
    return int(min(max(4 << 20, 8 * n_bytes**0.5), 64 << 20))


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that no fit may read: crc32 of the key as text, modulo 4, is 2."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(df: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the whole row, the same in every run.

    All rows if there are no more than ``limit``. With ``by`` every group has an equal part of the
    limit, and all its rows where it has fewer. A key on many rows is no more than those rows:
    the hash covers every column, and rows that are equal in all of them are counted first and
    sampled by their number. What is chosen is a table of at most ``limit`` checksums.
    """
    if df.limit(limit + 1).count() <= limit:
        return df
    group = F.col(by) if by else F.lit(0)
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.xxhash64(*df.columns).alias("mark"),
                     group.alias("part"))
    counts = stage(rows.groupBy("mark").agg(F.first("part").alias("part"), F.count("*").alias("n")), "row_counts")
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    parts = parts.withColumn("share", F.least(F.lit(1.0), limit / F.lit(parts.count()) / F.col("total")))
    u = F.pmod(F.xxhash64(F.lit("sample"), "mark"), F.lit(1 << 30)) / float(1 << 30)
    same = counts["part"].eqNullSafe(parts["part"])
    taken = counts.join(parts, same).select("mark", u.alias("u"), F.floor(F.col("n") * F.col("share") + u).alias("times"))
    taken = taken.filter("times > 0").orderBy("u", "mark").limit(limit)
    chosen = rows.join(F.broadcast(taken), "mark").groupBy("mark").agg(F.first("row").alias("row"), F.first("times").alias("times"))
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).limit(limit).select("row.*")
