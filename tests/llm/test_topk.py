"""Exact top-k search against all pairs in plain Python."""

from __future__ import annotations

import math
import random
from itertools import groupby

import numpy as np
import pyspark.sql.functions as F
import pytest

from tidecast.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def expected(rows, k=5, scale=256, chosen=lambda i: i is not None and i % 50 == 0):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(usable):
        if chosen(i):
            scored = [(-max(min(sum(a * b for a, b in zip(q, c, strict=False)), (1 << 63) - 1), -(1 << 63)),
                       j is None, j or 0) for m, (j, c) in enumerate(usable) if m != n]
            out += [(i, r, None if none else j, -s)
                    for r, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(rng, n, d):
    return [(i, [rng.uniform(-1, 1) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("tile", [(1024, 4096), (3, 7)])
def test_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "LEAST_SHARD_BYTES", 4000)
    rows = vectors(random.Random(1), 420, 6)
    assert got(topk.top_k(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_many_shards_and_groups_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 1200)
    monkeypatch.setattr(topk, "GROUP_BYTES", 400)
    rows = vectors(random.Random(2), 330, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(topk.top_k(frame, F.col("vec_id") % 10 == 0, k=3)) == expected(rows, 3, chosen=lambda i: i % 10 == 0)


def test_ties_copies_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_SHARD_BYTES", 500)
    rng = random.Random(3)
    rows = [(i, [0.5, 0.25]) for i in range(90)] + [(50, [0.5, 0.25])] * 3 + [(50, [1.0, 0.0])] * 2
    rows += [(0, [0.5, 0.25]), (7, [1.0, 0.0]), (None, [2.0, 2.0]), (None, [0.5, 0.25]), (-50, [0.1, 0.2])]
    rng.shuffle(rows)
    assert got(topk.top_k(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_a_third_of_all_rows_is_one_row(spark):
    rows = [(100, [0.5, -0.5])] * 60 + vectors(random.Random(4), 120, 2)
    assert got(topk.top_k(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_unusable_rows_lengths_and_clashing_columns(spark):
    rows = vectors(random.Random(5), 60, 4) + [
        (100, None), (150, [1.0, None]), (200, [float("nan")]), (250, [float("inf"), 1.0]), (300, []),
        (350, [1.0, 2.0]), (400, [-1.0] * 9), (3, [0.0, 0.0]), (None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("row", "v", "copies", "shard", "group", "node", "rank", "score", "times")})
    assert got(topk.top_k(frame)) == expected(rows)


def test_few_or_no_rows(spark):
    assert got(topk.top_k(spark.createDataFrame([], SCHEMA))) == []
    assert got(topk.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA))) == []
    rows = [(0, [1.0]), (50, [2.0])]
    assert got(topk.top_k(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("size", [3.0, 2.0**20, 2.0**26, 2.0**60])
def test_products_stay_exact_for_numbers_of_any_size(spark, size):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-int(size), int(size))) for _ in range(5)]) for i in range(40)]
    assert got(topk.top_k(spark.createDataFrame(rows, SCHEMA), scale=1)) == expected(rows, scale=1)


def test_best_keeps_the_first_of_equal_scores():
    scores = np.array([[1, 3, 3, 2, 3], [0, 0, 0, 0, 0]], np.int64)
    row, column = topk.best(scores, 2)
    assert [[int(c) for _, c in g] for _, g in groupby(zip(row, column, strict=True), key=lambda x: x[0])] == [[1, 2], [0, 1]]
