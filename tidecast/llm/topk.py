"""Exact top-k search by inner product: tiled matrix products and a merge tree of top lists.

Vectors become integers, floor(scale * x). Candidates are dealt to shards and queries to
groups, by hash; a (group, shard) cell multiplies tiles of its queries with tiles of its
candidates and keeps the best of each tile. The top lists of a query then meet in a tree,
sixteen shards at a time. Products are exact: single precision while no sum can reach 2^24,
double precision below 2^53, integers of any size beyond.

Rows that repeat both key and vector are one row with a count until the end, so copies are
neither multiplied again nor lost: a row's copies are candidates of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidecast.llm import base
from tidecast.staging import salts, stage

TILE = 1024, 4096
SHARD_BYTES, LEAST_SHARD_BYTES, GROUP_BYTES = 32 << 20, 1 << 20, 16 << 20
FAN_IN = 16
LONGEST = (1 << 63) - 1


def integers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``vec_id, v`` (components as long), of rows whose components are all finite numbers."""
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def matrices(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, with their vectors as one matrix."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    size, values = np.diff(offsets), column.values.to_numpy()
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, values[offsets[rows][:, None] + np.arange(d)]))
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; beyond 64 bits they stop at the largest long."""
    d = min(left.shape[1], right.shape[1])
    left, right = left[:, :d], right[:, :d]
    reach = lambda m: max(int(m.max()), -int(m.min()), 0) if m.size else 0
    most = reach(left) * reach(right) * d
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return left.astype(kind) @ right.astype(kind).T
    if most <= LONGEST:
        return left @ right.T
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row; of equal ones the first columns."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        row, column = np.nonzero(scores >= least)
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((column, _descending(scores[row, column]), row))
    return firsts(row[order], column[order], k)


def _descending(scores: np.ndarray) -> np.ndarray:
    """Sort key for falling scores; negating the least long would not change it."""
    return ~scores if scores.dtype == np.int64 else -scores


def firsts(group: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each run of equal groups."""
    start = np.searchsorted(group, group, side="left")
    keep = np.arange(len(group)) - start < k
    return group[keep], value[keep]


def cell(queries: pa.Table, candidates: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score: the k best candidates of each query, tile by tile.

    Candidates must ascend by the rule for ties.
    """
    rows, columns = queries.num_rows, candidates.num_rows
    found = [(np.zeros(0, np.int64),) * 3]
    blocks = matrices(candidates["v"]) if columns else []
    for own, left in matrices(queries["v"]) if rows else []:
        for lo in range(0, len(own), TILE[0]):
            hits = [(np.zeros(0, np.int64),) * 3]
            for other, right in blocks:
                for at in range(0, len(other), TILE[1]):
                    scores = products(left[lo:lo + TILE[0]], right[at:at + TILE[1]])
                    row, column = best(scores, k)
                    hits.append((own[lo + row], other[at + column], scores[row, column].astype(np.int64)))
                if len(hits) > FAN_IN:
                    hits = [merged(hits, k)]
            found.append(merged(hits, k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """One top list per query from those of several tiles."""
    query, candidate, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((candidate, ~score, query))
    _, order = firsts(query[order], order, k)
    return query[order], candidate[order], score[order]


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = 5, scale: float = 256, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k highest integer inner products.

    ``queries`` is a condition on ``vec_id``; without it keys divisible by 50 are queries.
    Every other row is a candidate, also one that repeats the query's key or the whole query.
    Ties go to the smaller key, a null key comes last; a null key is a candidate but no query
    unless the condition says so. Rows whose vector is null or holds a null or a number that
    is not finite take no part. Of vectors of different length the common components count;
    an empty vector scores 0 with all. Components and scores beyond 64 bits become the largest
    long (the smallest below zero), and such scores tie.
    Repeated query rows have a list each. Without candidates a query has no row.
    """
    spark = vectors.sparkSession
    base.ship(spark)
    chosen = F.col("vec_id") % 50 == 0 if queries is None else queries
    rows = integers(vectors, key, vector, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(chosen)
    size = lambda df: 8 * (df.agg(F.sum(F.size("v") + 4)).first()[0] or 0)
    n_groups = base.buckets(size(asked), GROUP_BYTES)
    # few large shards send each query to few places; more while there are idle tasks
    n_shards = max(base.buckets(n_bytes := size(rows), SHARD_BYTES),
                   min(base.buckets(n_bytes, LEAST_SHARD_BYTES), -(-salts(spark) // n_groups)))
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"group": place(n_groups), "shard": everywhere(n_shards)})
    right = rows.withColumns({"shard": place(n_shards), "group": everywhere(n_groups)})

    def run(cell_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        absent = right["vec_id"].is_null().to_numpy()
        right = right.take(np.lexsort((right["vec_id"].fill_null(0).to_numpy(), absent)))
        query, candidate, score = cell(left, right, k + 1)
        own = left["row"].to_numpy()[query] == right["row"].to_numpy()[candidate]
        copies = right["copies"].to_numpy()[candidate] - own
        out = pa.Table.from_arrays(
            [left["row"].take(query), left["vec_id"].take(query), left["copies"].take(query),
             pa.array(np.full(len(query), cell_key[1].as_py(), np.int32)), right["vec_id"].take(candidate),
             pa.array(score), pa.array(np.minimum(copies, k))], names=HITS.fieldNames())
        return out.filter(pa.array(copies > 0))

    hits = left.groupBy("group", "shard").cogroup(right.groupBy("group", "shard")).applyInArrow(base.keyed_tidy(run), HITS)
    hits = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    for _ in range(max(1, int(np.ceil(np.log(n_shards) / np.log(FAN_IN) - 1e-9)))):
        hits = hits.withColumn("node", (F.col("node") / FAN_IN).cast("int")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("row", "node").orderBy(*order))).filter(F.col("rank") <= k)
    return base.repeated(stage(hits, "top_lists"), "times").select("query_id", "rank", "vec_id", "score")


HITS = T.StructType([T.StructField(*x) for x in (
    ("row", T.LongType()), ("query_id", T.LongType()), ("times", T.LongType()), ("node", T.IntegerType()),
    ("vec_id", T.LongType()), ("score", T.LongType()), ("copies", T.LongType()))])


def oracle() -> str:
    """The same in DuckDB, by comparing each query with every other row."""
    return """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5"""
