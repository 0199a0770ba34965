"""Stupid-backoff scores of documents under the n-grams of the whole corpus, computed by joins.

Documents are dealt to chunks by hash. Order by order, a chunk emits its distinct n-grams with
their counts, cut by hash range into buckets; each bucket sums the counts of all chunks (the
n-gram count table, partitioned by hash) and joins them back to what the chunks emitted. At
last a chunk sums the scores of its documents. N-grams travel as packed arrays of hashes,
so a hot n-gram arrives once per chunk and every bucket and chunk has a bounded size.

A document never counts for itself: its own counts are taken off first, so that an n-gram
which no other document has backs off. For the same reason an n-gram is only emitted if
other documents have its first and its last n - 1 words: otherwise none has the n-gram.

The score of word w after context u is c(uw) / c(u) if c(uw) > 0, else alpha times the score
of w after the shorter context; without context it is c(w) / N, or 1 / (N + 1) for a word of
no other document, N being the words of the other documents. Contexts do not cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base
from tidecast.llm.columnar import (
    combine, hashes, pack_counts, pack_sorted, parts, starts_of_runs, unpack_counts,
    unpack_sorted, words,
)

#: N-grams are told apart by this many bits: at 10^11 different ones, one in three
#: thousand shares its number with another.
BITS = 48


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of a text column."""
    h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, data, offsets in parts(column, 1 << 20):
        start, end, of = words(data, offsets)
        h.append(hashes(data, start, end))
        doc.append(of + lo)
    return np.concatenate(h), np.concatenate(doc)


def count_text(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in parts(batch["text"]):
                n = len(words(data, offsets)[0])
                yield pa.RecordBatch.from_pydict({"b": pa.array([len(data)], pa.int64()),
                                                  "w": pa.array([n], pa.int64())})

    got = docs.select("text").mapInArrow(base.tidy(run), "b long, w long").agg(F.sum("b"), F.sum("w")).first()
    return got[0] or 0, got[1] or 0


class Grams:
    """N-grams of a chunk's documents, order by order, from the corpus counts found so far."""

    def __init__(self, column: pa.Array) -> None:
        self.h, self.doc = word_hashes(column)
        self.key = self.h
        self.others: list[np.ndarray] = []
        self.last = np.arange(len(self.h))
        self._name()

    def _name(self) -> None:
        self.distinct, self.of = np.unique(self.key[self.last] >> np.uint64(64 - BITS), return_inverse=True)

    def found(self, total: np.ndarray) -> None:
        """Take the corpus counts of ``distinct`` and go on to the n-grams one word longer."""
        pair = self.of.astype(np.int64) * (int(self.doc[-1]) + 1 if len(self.doc) else 1) + self.doc[self.last]
        order = np.argsort(pair, kind="stable")
        first = starts_of_runs(pair[order])
        size = np.diff(np.append(first, len(pair)))
        own = np.empty(len(pair), np.int64)
        own[order] = np.repeat(size, size)
        others = np.zeros(len(self.h), np.int64)
        others[self.last] = total[self.of] - own
        self.others.append(others)
        k = len(self.others)
        last = np.arange(k, max(len(self.h), k))
        last = last[(self.doc[last] == self.doc[last - k]) & (others[last] > 0) & (others[last - 1] > 0)]
        if len(self.h):
            self.key = np.concatenate([self.key[:1], combine(self.key[:-1], self.h[1:])])
        self.last = last
        self._name()

    def depth(self) -> np.ndarray:
        """Number of words before each one in its document."""
        first = starts_of_runs(self.doc)
        return np.arange(len(self.doc)) - np.repeat(first, np.diff(np.append(first, len(self.doc))))


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_words, log10_score, mean_log10, perplexity, n_backoff`` for every whole text.

    ``n_backoff`` counts the words scored after a shorter context than stands before them.
    A text without words (null, empty) has 0 words, score 0 and null mean and perplexity.
    Equal texts under different keys are different documents and see each other; rows that
    repeat a key are documents of their own as well.
    """
    spark = docs.sparkSession
    base.ship(spark)
    docs = base.documents(docs, key, text)
    size, n_words = count_text(docs)
    n_chunks = base.buckets(size, base.chunk_bytes(size))
    n_buckets = base.buckets(size, 4 * base.chunk_bytes(size))
    cuts = (np.arange(1, n_buckets, dtype=object) * (1 << BITS) // n_buckets).astype(np.uint64)
    chunks = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    def known(docs: pa.Table, totals: pa.Table | None, orders: int) -> Grams:
        grams = Grams(docs["text"])
        if orders:
            held = dict(zip(zip(totals["n"].to_pylist(), totals["bucket"].to_pylist(), strict=True),
                            totals["counts"].to_pylist(), strict=True))
            for k in range(orders):
                got = [unpack_counts(held.pop((k, b))) for b in range(n_buckets) if (k, b) in held]
                grams.found(np.concatenate(got) if got else np.zeros(0, np.int64))
        return grams

    def emitted(chunk: int, k: int, grams: Grams) -> pa.Table:
        count = np.bincount(grams.of, minlength=len(grams.distinct))
        edges = [0, *np.searchsorted(grams.distinct, cuts).tolist(), len(grams.distinct)]
        rows = [(chunk, k, b, pack_sorted(grams.distinct[lo:hi]), pack_counts(count[lo:hi]))
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, GRAM_TYPES, strict=True)],
                                    names=["chunk", "n", "bucket", "grams", "counts"])

    def first(docs: pa.Table) -> pa.Table:
        return emitted(docs["chunk"][0].as_py(), 0, known(docs, None, 0))

    def later(k: int):
        def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
            chunk = totals["chunk"][0].as_py() if totals.num_rows else 0
            return emitted(chunk, k, known(docs, totals, k))
        return run

    def total(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["grams"].to_pylist()]
        n = np.concatenate([unpack_counts(x) for x in table["counts"].to_pylist()])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, n, len(distinct)).astype(np.int64)[at]
        split = np.split(count, np.cumsum([len(x) for x in keys])[:-1])
        return pa.Table.from_pydict({"chunk": table["chunk"], "n": table["n"], "bucket": table["bucket"],
                                     "counts": pa.array([pack_counts(x) for x in split], pa.binary())})

    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        grams = known(docs, totals, order)
        n, doc, depth = docs.num_rows, grams.doc, grams.depth()
        own = np.bincount(doc, minlength=n)
        rest = (n_words - own)[doc]
        result = np.where(grams.others[0] > 0, np.log10(np.maximum(grams.others[0], 1) / np.maximum(rest, 1)),
                          -np.log10(rest + 1.0))
        level = np.zeros(len(doc), np.int64)
        for k in range(1, order):
            result += np.where(depth >= k, np.log10(alpha), 0)
            at = np.flatnonzero(grams.others[k] > 0)
            result[at] = np.log10(grams.others[k][at] / grams.others[k - 1][at - 1])
            level[at] = k
        missed = np.bincount(doc[level < np.minimum(depth, order - 1)], minlength=n)
        return pa.Table.from_pydict({
            "doc_id": docs["doc_id"], "n_words": own.astype(np.int64),
            "log10_score": np.bincount(doc, result, n).astype(float), "n_backoff": missed.astype(np.int64)})

    counted = "chunk int, n int, bucket int, counts binary"
    emission = "chunk int, n int, bucket int, grams binary, counts binary"
    rows = chunks.groupBy("chunk").applyInArrow(base.tidy(first), emission)
    totals = rows.groupBy("bucket").applyInArrow(base.tidy(total), counted)
    for k in range(1, order):
        rows = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(base.tidy(later(k)), emission)
        totals = totals.unionByName(rows.groupBy("bucket").applyInArrow(base.tidy(total), counted))
    scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        base.tidy(score), "doc_id long, n_words long, log10_score double, n_backoff long")
    mean = F.expr("CASE WHEN n_words > 0 THEN log10_score / n_words END")
    return scored.select("doc_id", "n_words", "log10_score", mean.alias("mean_log10"),
                         F.pow(F.lit(10.0), -mean).alias("perplexity"), "n_backoff")


GRAM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
