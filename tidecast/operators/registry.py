"""Registry of tuned windows: what to insert, replace, flag or refuse, and its stored table.

The table is partitioned by channel. An upsert reads and rewrites only the channels that
have new rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecast.sources.sinks import replace_partitions
from tidecast.staging import stage

HIGH_ERROR = 0.08
REJECT_ERROR = 0.15


def registry_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after an insert.

    Incoming rows above the reject error drop, above the high error they are
    flagged, and windows that touch January are marked. Of rows of one channel and
    window the lowest error stays; on a tie the existing row.
    """
    both = existing.withColumn("is_new", F.lit(0)).unionByName(
        accepted(incoming).withColumn("is_new", F.lit(1))
    )
    w = Window.partitionBy("channel", "window_start", "window_end").orderBy(
        "abs_err", "is_new", F.col("run_date").desc(), "label"
    )
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "is_new")


def accepted(incoming: DataFrame) -> DataFrame:
    """Rows that are not refused, with their flags."""
    january = (F.month("window_start") == 1) | (F.month("window_end") == 1)
    return incoming.filter(F.col("abs_err") <= REJECT_ERROR).withColumns(
        {"high_error_flag": F.col("abs_err") > HIGH_ERROR, "january_only": january}
    )


def read_registry(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored registry; empty before the first upsert."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store_registry(registry: DataFrame, path: str) -> None:
    """Write a registry as it is; channels that it does not have stay."""
    replace_partitions(registry, path, ("channel",))


def upsert_registry(incoming: DataFrame, path: str) -> DataFrame:
    """Put new rows into the stored registry and return it as it is then.

    Channels without an accepted row are neither read nor written. The new state of the others
    is complete in the shared folder before the first file of the table is replaced.
    """
    spark, schema = incoming.sparkSession, incoming.schema
    incoming = stage(incoming, "incoming")
    touched = accepted(incoming).select(F.col("channel").alias("touched")).distinct()
    old = read_registry(spark, path, schema).join(
        touched, F.col("channel").eqNullSafe(F.col("touched")), "left_semi")
    store_registry(stage(registry_upsert(old, incoming), "upserted"), path)
    return read_registry(spark, path, schema)


def registry_latest(registry: DataFrame) -> DataFrame:
    """Latest run of every label; of runs on one date the lowest error."""
    w = Window.partitionBy("label").orderBy(F.col("run_date").desc(), "abs_err")
    return registry.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def union_anchor_channels(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
