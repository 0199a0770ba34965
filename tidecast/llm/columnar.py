"""Numpy views of Arrow text columns: documents, words, lines and their hashes.

Tasks handle Arrow batches, not single documents: a text column is one byte buffer
with offsets, so words of thousands of documents are found and hashed in a few
array operations. ``slices`` bounds what is held at once by a number of bytes, except
that a single document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BLOCK = (1 << 19) - 4096
_RATIO = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_RATIO, -1, 1 << 64)

# ASCII space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=2)
def _powers(n: int, ratio: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(ratio, done, 1 << 64))
        done += step
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def parts(column: pa.Array, limit: int = SLICE_BYTES):
    """First row, bytes and offsets of each slice of a text column."""
    data, offsets = texts(column)
    for lo, hi in slices(offsets, limit):
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The document that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the maximal runs of set flags; runs end with their document."""
    first = inside.copy()
    last = inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, owner(offsets, starts)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes that are not ASCII white space."""
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the non-empty lines."""
    return spans(data != 10, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes have equal hashes wherever they stand.

    Spans must be in ascending order of their start. Differences of prefix sums of a
    polynomial in the position, shifted back to position zero, so that the work is
    linear in the bytes. Blocks bound the memory.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        upto = int(np.searchsorted(starts, lo + BLOCK, side="left"))
        upto = max(upto, at + 1)
        hi = int(ends[at:upto].max())
        n = hi - lo
        size = 1 << max(18, int(n).bit_length())
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * _powers(size, _RATIO)[:n], out=total[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        out[at:upto] = (total[e] - total[s]) * _powers(size, _INVERSE)[s]
        out[at:upto] += (e - s).astype(np.uint64)
        at = upto
    return mix(out)


def combine(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several, in their order."""
    h = columns[0].astype(np.uint64)
    for c in columns[1:]:
        h = mix(h * np.uint64(_RATIO) + c.astype(np.uint64))
    return h


def starts_of_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, all first bytes, then all second bytes and so on.

    The high bytes of the differences are zero, which the block compression of Spark's
    files removes; nothing is lost.
    """
    values = values.astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """64-bit numbers, most of them small, by byte planes."""
    return np.ascontiguousarray(values).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()
