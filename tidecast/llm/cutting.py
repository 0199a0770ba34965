"""Cutting byte spans out of texts: the step that the removing operators share.

Rows are told apart by their key and, where keys repeat, by a checksum of the text, so that
spans found in one text are never cut out of another. A null key stands above all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import base
from tidecast.llm.columnar import combine, pack_counts, spans, starts_of_runs, texts, unpack_counts

NULL_KEY = (1 << 63) - 1


def key_and_text(key: str = "doc_id", text: str = "text") -> list[Column]:
    """``doc`` (the key, nulls last) and ``text`` (null: empty)."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``text`` and ``mark``, a checksum of the text."""
    return docs.select(*key_and_text(key, text)).withColumn("mark", F.hash("text"))


def coverage(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in at least one span."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def dealt(docs: DataFrame, n_chunks: int) -> DataFrame:
    """``keyed`` rows with the ``chunk`` in which their spans meet them; copies of a text are spread."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc", "mark"), F.lit(n_chunks)).cast("int"))


def pack(chunk: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Rows for ``cut``: one per chunk, with all spans of its documents."""
    order = np.argsort(chunk, kind="stable")
    first = starts_of_runs(chunk[order])
    spans_ = [pack_counts(np.concatenate([x[at] for x in (doc, mark, start, end)]))
              for at in np.split(order, first[1:])] if len(first) else []
    return pa.Table.from_pydict({"chunk": chunk[order][first].astype(np.int32),
                                 "spans": pa.array(spans_, pa.binary())})


REMOVED = "chunk int, spans binary"


def cut(docs: DataFrame, removed: DataFrame, least: int = 1) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of ``dealt`` rows.

    ``removed`` has the half-open byte spans of ``pack``, in any order and with overlaps.
    Joined spans of fewer than ``least`` bytes stay. What a document loses is bounded by its
    own length, so a chunk's spans are by the chunk's.
    """

    def run(docs: pa.Table, removed: pa.Table) -> pa.Table:
        data, offsets = texts(docs["text"])
        n = len(offsets) - 1
        found = [unpack_counts(x).reshape(4, -1) for x in removed["spans"].to_pylist()]
        doc, mark, start, end = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
        key = combine(doc, mark)
        order = np.argsort(key, kind="stable")
        key, start, end = key[order], start[order], end[order]
        own = combine(docs["doc"].to_numpy(), docs["mark"].to_numpy().astype(np.int64))
        low, high = np.searchsorted(key, own, side="left"), np.searchsorted(key, own, side="right")
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(low, high, strict=True))])
        shift = np.repeat(offsets[:-1], high - low)
        gone = coverage(len(data), start[at] + shift, end[at] + shift)
        first, last, of = spans(gone, offsets)
        long = last - first >= least
        gone, of = coverage(len(data), first[long], last[long]), of[long]
        total = np.concatenate(([0], np.cumsum(~gone)))[offsets].astype(np.int64)
        kept = data[~gone].tobytes()
        size = np.diff(offsets)
        return pa.Table.from_pydict({
            "doc": docs["doc"], "n_bytes": size, "n_removed": size - np.diff(total),
            "n_spans": np.bincount(of, minlength=n).astype(np.int64),
            "kept": pa.array([kept[a:b] for a, b in zip(total, total[1:], strict=False)], pa.binary())})

    base.ship(docs.sparkSession)
    out = docs.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(
        base.tidy(run), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.expr(f"nullif(doc, {NULL_KEY}L)").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
