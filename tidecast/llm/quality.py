"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Cosines of random projections approximate a Gaussian kernel over the statistics of a
text. Each task adds the products of its rows to normal equations, which Spark sums by
cell; only (features + 1)^2 numbers reach the driver. Scores of rows that the fit has not
seen are then mapped to probabilities by pooling adjacent violators on binned counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base, textstats
from tidecast.llm.rules import known_labels

BINS = 2_000


@dataclass
class Kernel:
    """Standardises the ratios and maps them to random cosines."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        phi = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([phi, np.ones(len(x))])


@dataclass
class Model:
    kernel: Kernel
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.kernel(x) @ self.beta, -1, 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with a ``label`` of 0 or 1; other labels are skipped, of several the least counts."""
    return statistics.join(known_labels(labels), "doc_id")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = textstats.ratios(batch)
            yield pa.RecordBatch.from_pydict({
                "i": np.arange(x.shape[1], dtype=np.int32), "n": np.full(x.shape[1], len(x), np.int64),
                "s": x.sum(axis=0), "q": (x * x).sum(axis=0)})

    got = (rows.select("doc_id", *textstats.NAMES).mapInArrow(base.tidy(run), "i int, n long, s double, q double")
           .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
           .orderBy("i").toArrow().to_pandas())
    if not len(got):
        return np.zeros(0), np.zeros(0), 0
    n = int(got["n"].iloc[0])
    mean = (got["s"] / n).to_numpy()
    return mean, np.sqrt(np.maximum((got["q"] / n).to_numpy() - mean**2, 1e-6)), n


def train(rows: DataFrame, features: int = 256, width: float = 3.0, ridge: float = 1e-3,
          max_rows: int = 200_000, seed: int = 11) -> Model | None:
    """Fit on labelled statistics: three quarters give the ridge weights, the rest the calibration.

    ``max_rows`` bounds the rows used, chosen by hash. None without rows of either part.
    """
    base.ship(rows.sparkSession)
    rows = base.sampled(rows, max_rows)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4))
    fit_rows, check_rows = rows.filter(part != 0), rows.filter(part == 0)
    centre, spread, n = _moments(fit_rows)
    if not n:
        return None
    rng = np.random.default_rng(seed)
    kernel = Kernel(centre, spread, rng.normal(0, 1 / width, (len(centre), features)),
                    rng.uniform(0, 2 * np.pi, features))
    names = ["doc_id", *textstats.NAMES, "label"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            phi = kernel(textstats.ratios(batch))
            y = batch["label"].to_numpy(zero_copy_only=False).astype(float)
            total += phi.T @ np.column_stack([phi, y])
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    tasks = max(1, min(16, n // 5_000))
    got = (fit_rows.select(*names).repartition(tasks).mapInArrow(base.tidy(products), "i int, j int, v double")
           .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())
    a = np.zeros((features + 1, features + 2))
    a[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    penalty = ridge * n * np.eye(features + 1) / features
    penalty[-1, -1] = 0
    beta = np.linalg.solve(a[:, :-1] + penalty + 1e-9 * np.eye(features + 1), a[:, -1])
    model = Model(kernel, beta, np.array([-1.0, 2.0]), np.array([0.0, 1.0]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.floor((model.raw(textstats.ratios(batch)) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": b, "label": batch["label"].cast(pa.int32())})

    got = (check_rows.select(*names).mapInArrow(base.tidy(bins), "bin int, label int").groupBy("bin")
           .agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("bin").toArrow().to_pandas())
    if len(got):
        n = got["n"].to_numpy()
        model.knots = (got["bin"].to_numpy() + 0.5) / BINS * 3 - 1
        model.values = np.clip(pool_adjacent(got["good"].to_numpy() / n, n.astype(float)), 0, 1)
    return model


def score(statistics: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score``: calibrated probability of label 1; 0.5 under a model of nothing."""
    base.ship(statistics.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(textstats.ratios(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": s})

    return statistics.select("doc_id", *textstats.NAMES).mapInArrow(base.tidy(run), "doc_id long, score double")
