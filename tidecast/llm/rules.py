"""Quality rules: fixed limits on word counts, then an isolation forest on rule statistics.

Random axis-parallel splits isolate unusual rows after few steps; the mean path length
over many small trees gives each document a score between 0 and 1. The cut-off is
taken from labelled rows: as low as leaves at most ``false_rate`` of the good ones out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base, textstats
from tidecast.llm.columnar import parts

BINS = 10_000


@dataclass
class Forest:
    """Trees as arrays (tree, node): feature (-1 in a leaf), threshold, first child, path length."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    length: np.ndarray
    mean_length: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, c, length in zip(self.feature, self.threshold, self.child, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = f[at]
                inner = feature >= 0
                right = x[rows, np.maximum(feature, 0)] >= t[at]
                at = np.where(inner, c[at] + right, at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.mean_length)


def _mean_path(n: int | np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n keys."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow(sample: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, rows: int, depth: int,
         seed: int) -> Forest:
    """Trees on random subsets of the sample.

    A node splits a random feature at a random place of the node's box, which starts as
    ``low`` to ``high`` and may reach beyond the sample: what lies where no sample row does is
    then cut off after few steps.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    nodes = 2 ** (depth + 1)
    feature = np.full((trees, nodes), -1)
    threshold, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    child = np.zeros((trees, nodes), np.int64)
    for k in range(trees):
        todo = [(0, sample[rng.choice(len(sample), rows, replace=False)], low, high, 0)]
        used = 1
        while todo:
            node, x, lo, hi, d = todo.pop()
            open_ = np.flatnonzero(hi > lo)
            if d == depth or len(x) < 2 or not len(open_):
                length[k, node] = d + _mean_path(len(x))
                continue
            f = rng.choice(open_)
            t = rng.uniform(lo[f], hi[f])
            feature[k, node], threshold[k, node], child[k, node] = f, t, used
            right = x[:, f] >= t
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = t
            todo += [(used, x[~right], lo, below, d + 1), (used + 1, x[right], above, hi, d + 1)]
            used += 2
    return Forest(feature, threshold, child, length, max(float(_mean_path(rows)), 1e-9), depth)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Ratios of the counts on a logarithmic scale, so that a split between none and a few is likely."""
    return np.log(textstats.ratios(table) + 0.01)


def known_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``doc_id, label``: one label of 0 or 1 per key; others and null keys are skipped."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.filter("label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))


def box(statistics: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest value of each feature over all rows; None if there are none.

    Tasks send a row per feature, so a fixed number of rows reaches the driver.
    """
    base.ship(statistics.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(textstats.FEATURES), np.inf), np.full(len(textstats.FEATURES), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = features(batch)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if (low <= high).all():
            yield pa.RecordBatch.from_pydict(
                {"feature": pa.array(np.arange(len(low)), pa.int32()), "low": low, "high": high})

    ends = (statistics.mapInArrow(base.tidy(run), "feature int, low double, high double")
            .groupBy("feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .orderBy("feature").toArrow())
    return (ends["low"].to_numpy(), ends["high"].to_numpy()) if len(ends) else None


def fit(statistics: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 200,
        rows: int = 256, depth: int = 10, seed: int = 7) -> Forest | None:
    """Forest of the documents that pass the fixed limits; None if there are none.

    Trees are grown on a bounded, hash-chosen sample of at most ``max_rows`` of those
    labelled good (of all where none is); the box is that of all, every row is read for it.
    """
    names = ["doc_id", *textstats.NAMES]
    passed = statistics.filter(~base_failed()).select(*names)
    extent = box(passed)
    if extent is None:
        return None
    good = passed.join(known_labels(labels).filter("label = 1"), "doc_id", "left_semi")
    for some in (good, passed):
        sample = features(base.sampled(some, max_rows).orderBy(*names).toArrow())
        if len(sample):
            break
    return grow(sample, *extent, trees, rows, depth, seed)


def score(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """The statistics and ``anomaly``, 0 to 1; 0 everywhere under a forest of nothing."""
    base.ship(statistics.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.scores(features(batch)) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s)], names=[*batch.schema.names, "anomaly"])

    columns = statistics.select("doc_id", *textstats.NAMES)
    return columns.mapInArrow(base.tidy(run), textstats.SCHEMA + ", anomaly double")


def threshold(scored: DataFrame, labels: DataFrame, false_rate: float = 0.003) -> float:
    """Lowest anomaly from which on at most ``false_rate`` of the good labelled rows lie; 1 without labels.

    Works on counts per step of the score, so a fixed number of rows reaches the driver.
    """
    counts = (scored.filter(~base_failed()).join(known_labels(labels), "doc_id")
              .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
              .agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect())
    good = np.zeros(BINS + 2)
    for r in counts:
        good[r["bin"]] += r["good"]
    if not counts or not good.sum():
        return 1.0
    above = np.cumsum(good[::-1])[::-1]
    return float(np.flatnonzero(above <= false_rate * good.sum())[0]) / BINS


def judge(scored: DataFrame, cut: float) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: neither failed nor as unusual as ``cut``."""
    return (scored.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut)))


def passing(docs: DataFrame, forest: Forest | None, cut: float, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; texts stay where they are."""
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in parts(batch[text].cast(pa.string()), textstats.SLICE):
                got = {k: pa.array(v.astype(np.int64)) for k, v in textstats.statistics(data, offsets).items()}
                table = pa.Table.from_pydict(got)
                words, again = got["n_words"].to_numpy(), got["n_repeat_words"].to_numpy()
                anomaly = forest.scores(features(table)) if forest else np.zeros(len(table))
                kept = (words >= 50) & (100 * again <= 50 * words) & (anomaly < cut)
                yield batch.slice(lo, len(table)).filter(pa.array(kept))

    return docs.mapInArrow(base.tidy(run), docs.schema)
