"""Substring dedup by content-defined chunks.

A gear hash rolls over the last 16 bytes; a chunk ends where its value is the least within
``reach`` bytes on either side, so boundaries depend on nearby content alone and come back
after any insertion. Each chunk is identified by a 128-bit digest; the first occurrence by
(document, position) stays and every other one is cut out where neighbouring repeated
chunks come to ``least`` bytes together. Small chunks follow a repeated passage closely, and the
least length leaves alone what short phrases have in common.

Tasks keep the first occurrence of each digest they meet and cut the others themselves; only
the firsts are exchanged, by digest. A chunk that a third of all documents hold thus arrives
once per task (more exactly: once per ``FLUSH`` chunks), packed with the others of its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidecast.llm import base, cutting
from tidecast.llm.columnar import mix, owner, pack_counts, parts, unpack_counts

GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
WINDOW = 16
FLUSH = 500_000


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes that end at each position; its top 16 bits and more see all of them."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return (h >> np.uint64(24)).astype(np.uint32)


def least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of the ``reach`` values before each position; the largest number where there are fewer."""
    top = np.uint32(0xFFFFFFFF)
    if len(h) <= reach:
        return np.full(len(h), top)
    low, width = h.copy(), 1  # minimum of the ``width`` values that end here
    while 2 * width <= reach:
        low[width:] = np.minimum(low[width:], low[:-width])
        width *= 2
    out = np.full(len(h), top)
    out[reach:] = np.minimum(low[reach - 1:-1], low[width - 1:len(h) - 1 - (reach - width)])
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray, reach: int, longest: int) -> np.ndarray:
    """Ends of all chunks, document ends among them; no chunk is longer than ``longest`` bytes."""
    h = rolling(data)
    low = (h < least_before(h, reach)) & (h <= least_before(h[::-1], reach)[::-1])
    at = np.flatnonzero(low)
    doc = owner(offsets, at)
    inner = (at - offsets[doc] >= reach + WINDOW - 1) & (offsets[doc + 1] - at > reach)
    ends = np.union1d(at[inner] + 1, offsets[1:][np.diff(offsets) > 0])
    # long stretches without a minimum are cut at fixed steps from their start
    starts = np.concatenate(([0], ends[:-1]))
    extra = (ends - starts - 1) // longest
    if extra.any():
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        ends = np.union1d(ends, np.repeat(starts, extra) + step * longest)
    return ends


def chunks(data: np.ndarray, offsets: np.ndarray, reach: int = 12, longest: int = 1024):
    """Start, end and document of every chunk."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    end = boundaries(data, offsets, reach, longest)
    start = np.concatenate(([0], end[:-1]))
    return start, end, owner(offsets, start)


def _ordered(digest: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray):
    """Order by digest, then document and position, and the first of each digest."""
    order = np.lexsort((start, mark, doc, digest[:, 1], digest[:, 0]))
    d = digest[order]
    first = np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1))) if len(d) else np.zeros(0, bool)
    return order, first


def dedup_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 12,
                 least: int = 48, longest: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every whole text (UTF-8; null: empty).

    Chunks end at the same places in equal passages except within about ``reach`` + 16 bytes
    of the passage's ends. Repeats within a document are cut as well. Rows that repeat a key
    are ordered by a checksum of their text; rows that repeat key and text stay alike.
    """
    spark = docs.sparkSession
    base.ship(spark)
    rows = cutting.keyed(docs, key, text)
    size = base.text_bytes(rows)
    n_buckets = base.buckets(size, 2 * base.chunk_bytes(size))
    rows = cutting.dealt(rows, base.buckets(size, base.chunk_bytes(size)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            keys, marks, numbers = (batch[c].to_numpy() for c in ("doc", "mark", "chunk"))
            for lo, data, offsets in parts(batch["text"]):
                start, end, of = chunks(data, offsets, reach, longest)
                raw = data.tobytes()
                digest = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest()
                                  for a, b in zip(start.tolist(), end.tolist(), strict=True))
                held.append((np.frombuffer(digest, np.uint64).reshape(-1, 2), numbers[lo + of], keys[lo + of],
                             marks[lo + of], start - offsets[of], end - offsets[of]))
                if sum(len(x[1]) for x in held) >= FLUSH:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        digest, *place = (np.concatenate(x) for x in zip(*held, strict=True))
        _, doc, mark, start, _ = place
        order, first = _ordered(digest, doc, mark, start)
        lost = order[~first]
        packed = cutting.pack(*(x[lost] for x in place))
        n = len(packed)
        if n:  # these go through any bucket as they are
            any_ = pa.array(packed["chunk"].to_numpy() % n_buckets, pa.int32())
            none = pa.nulls(n, pa.binary())
            yield from pa.Table.from_arrays([any_, none, none, *packed.columns], names=NAMES).to_batches()
        order = order[first]
        bucket = (digest[order, 0] >> np.uint64(33)).astype(np.int64) * n_buckets >> 31
        edges = np.append(np.searchsorted(bucket, np.arange(n_buckets)), len(bucket))
        for b in range(n_buckets):
            at = order[edges[b]:edges[b + 1]]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([digest[at].tobytes()], pa.binary()),
                     pa.array([pack_counts(np.concatenate([x[at] for x in place]))], pa.binary()),
                     pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=NAMES)

    def firsts(table: pa.Table) -> pa.Table:
        met = table.filter(pc.is_valid(table["digests"]))
        known = table.filter(pc.is_null(table["digests"])).select(["chunk", "spans"])
        if not len(met):
            return known
        digest = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in met["digests"].to_pylist()])
        _, doc, mark, start, _ = place = np.concatenate(
            [unpack_counts(x).reshape(5, -1) for x in met["places"].to_pylist()], axis=1)
        order, first = _ordered(digest, doc, mark, start)
        return pa.concat_tables([known, cutting.pack(*place[:, order[~first]])])

    removed = (rows.mapInArrow(base.tidy(found), SCHEMA).groupBy("bucket")
               .applyInArrow(base.tidy(firsts), cutting.REMOVED))
    return cutting.cut(rows, removed, least)


NAMES = ["bucket", "digests", "places", "chunk", "spans"]
SCHEMA = "bucket int, digests binary, places binary, " + cutting.REMOVED
