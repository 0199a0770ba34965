"""Exact substring dedup by a distributed merge sort of suffixes with known common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller key. Not every suffix needs sorting. Of the 35 16-byte strings inside a 50-byte window the
one with the least hash is the window's anchor; equal windows have equal anchors at
equal offsets, and about one position in eighteen is an anchor. So it is enough to sort the
suffixes that start at anchors, as far as windows reach, together with the bytes before
them that windows reach back to.

1. Documents are dealt to chunks by hash. Chunks exchange the hashes of their anchors, packed by
   hash range; an anchor of one document only can hold no repeat and goes no further.
2. Each chunk sorts the distinct suffixes at its remaining anchors and sends them as runs,
   front-coded (bytes shared with the one before are left out) and cut at splitters. A
   splitter range merges its runs with a loser tree that carries common prefix lengths, so
   bytes once found equal are never compared again. The merged order and its prefix
   lengths give the groups of one anchor and the equal suffixes in them; per window the
   least key of its group is found. What goes back to a chunk is, for each suffix it sent, which of
   its windows start in a document with a smaller key.
3. Chunks cut what these windows cover out of their documents.

Equal suffixes of a chunk travel once, with the least key among them, so a passage that a
third of all documents hold arrives once per chunk. Anchors with more than
``hot_count`` occurrences could still meet with as many different surroundings in one range; their windows are
exchanged one by one by hash instead, which splits them, and joined the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm import base, cutting
from tidecast.llm.columnar import (
    _BYTES, _INVERSE, _RATIO, _powers, mix, pack_counts, pack_sorted, parts, spans,
    starts_of_runs, texts, unpack_counts, unpack_sorted,
)

ANCHOR = 16
#: Anchors have small hashes, being the least of a window; exchanged ones are hashed again to be even.
SALT = np.uint64(0x5851F42D4C957F2D)
#: Text hashed, and suffixes copied, at a time.
SLICE, ROWS = 1 << 19, 1 << 13


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes that start at each position."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    size = 1 << max(18, n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(size, _RATIO)[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * _powers(size, _INVERSE)[:n - width + 1])


@dataclass
class Anchors:
    """Anchors of a chunk in order of place: document, place in the joined bytes, first and last window start."""

    doc: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hash: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Anchors:
    reach = length - ANCHOR + 1
    found: list[tuple[np.ndarray, ...]] = []
    first = 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1, first + 1)
        base_ = int(offsets[first])
        part, off = data[base_:offsets[last]], offsets[first:last + 1] - base_
        h = rolling(part, ANCHOR)
        if len(part) >= length:
            # hash before place, so that the first of equal ones is taken
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= reach:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if reach > width:
                low = np.minimum(low[:len(low) - (reach - width)], low[reach - width:])
            ends = np.repeat(off[1:], np.diff(off))
            start = np.arange(len(low))
            valid = start + length <= ends[:len(low)]
            start, place = start[valid], (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            run = starts_of_runs(place)
            if len(run):
                end = np.append(run[1:] - 1, len(place) - 1)
                at = place[run]
                found.append((np.searchsorted(off, at, side="right") - 1 + first, at + base_,
                              start[run] + base_, start[end] + base_, mix(h[at] + SALT)))
        first = last
    none = np.zeros(0, np.int64)
    if not found:
        return Anchors(none, none, none, none, none.astype(np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


# A suffix is a row of fixed width: the bytes from the anchor to the end of its last window, how many
# there are, the bytes before it back to its first window, nearest first, and how many.

def suffix_rows(data: np.ndarray, a: Anchors, length: int) -> np.ndarray:
    back = length - ANCHOR
    right, left = a.high + length - a.at, a.at - a.low
    rows = np.zeros((len(a.at), _width(length)), np.uint8)
    padded = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(length, np.uint8)])
    for lo in range(0, len(rows), ROWS):
        some = slice(lo, lo + ROWS)
        at, r, n = a.at[some, None] + back, right[some, None], left[some, None]
        step = np.arange(length)
        rows[some, :length] = np.where(step < r, padded[at + step], 0)
        step = np.arange(back)
        rows[some, length + 1:length + 1 + back] = np.where(step < n, padded[at - 1 - step], 0)
    rows[:, length] = right
    rows[:, length + 1 + back] = left
    return rows


def _width(length: int) -> int:
    return -(-(2 * length - ANCHOR + 2) // 8) * 8


def sort_rows(rows: np.ndarray) -> np.ndarray:
    columns = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    return np.lexsort(columns.T[::-1])


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix length of each sorted row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Common prefix lengths, and what follows them."""
    lcp = common_prefixes(rows)
    rest = rows[np.arange(rows.shape[1]) >= lcp[:, None]]
    return lcp.astype(np.uint8).tobytes(), rest.tobytes()


def front_decode(lcps: bytes, rest: bytes, width: int) -> list[bytes]:
    out, at, row = [], 0, b""
    for n in lcps:
        size = width - n
        row = row[:n] + rest[at:at + size]
        at += size
        out.append(row)
    return out


def merge(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int]]:
    """Run of each row of the merged order and its common prefix length with the row before.

    A loser tree whose nodes keep, beside the losing run, the common prefix length of its row
    with the row that beat it. The row that moves up knows its own with the last winner, so
    unequal lengths decide without looking at bytes, and equal ones are compared from there on.
    """
    n = len(runs)
    leaves = 1 << max(0, (n - 1).bit_length())
    at = [0] * leaves
    head: list[bytes | None] = [rows[0] if rows else None for rows, _ in runs] + [None] * (leaves - n)
    loser, known = [0] * leaves, [0] * leaves

    def play(x: int, lx: int, y: int, ly: int) -> tuple[int, int, int, int]:
        """Winner and its length with the last output, loser and its length with the winner."""
        a, b = head[x], head[y]
        if a is None:
            return y, ly, x, 0
        if b is None:
            return x, lx, y, 0
        if lx != ly:  # the one that shares more with the last output comes first
            return (x, lx, y, ly) if lx > ly else (y, ly, x, lx)
        ra, rb = a[lx:], b[lx:]
        if ra == rb:
            return x, lx, y, len(a)
        differ = int.from_bytes(ra) ^ int.from_bytes(rb)
        shared = len(a) - (differ.bit_length() + 7) // 8
        return (x, lx, y, shared) if ra < rb else (y, lx, x, shared)

    # a first tournament from the leaves up
    winner: list[tuple[int, int]] = [(0, 0)] * leaves + [(i, 0) for i in range(leaves)]
    for node in range(leaves - 1, 0, -1):
        (x, lx), (y, ly) = winner[2 * node], winner[2 * node + 1]
        x, lx, loser[node], known[node] = play(x, lx, y, ly)
        winner[node] = (x, lx)
    x, lx = winner[1] if leaves > 1 else (0, 0)
    while head[x] is not None:
        yield x, lx
        rows, lcps = runs[x]
        at[x] += 1
        if at[x] < len(rows):
            head[x], lx = rows[at[x]], lcps[at[x]]
        else:
            head[x], lx = None, 0
        node = (leaves + x) >> 1
        while node:
            y, ly = loser[node], known[node]
            if head[x] is not None and head[y] is not None and lx > ly:
                pass  # the row on its way up wins unseen
            else:
                x, lx, loser[node], known[node] = play(x, lx, y, ly)
            node >>= 1


def least_keys(rows: np.ndarray, group: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """(rows x windows) least key over the windows equal to each one in its group.

    Windows are numbered by how far before the anchor they start; those that a row does not
    have get the largest number.
    """
    back = length - ANCHOR
    n = len(rows)
    out = np.full((n, back + 1), cutting.NULL_KEY)
    if not n:
        return out
    line = np.concatenate([rows[:, length + 1:length + 1 + back][:, ::-1], rows[:, :length]], axis=1)
    power, inverse = _powers(1 << 18, _RATIO), _powers(1 << 18, _INVERSE)
    total = np.zeros((n, line.shape[1] + 1), np.uint64)
    np.cumsum(_BYTES[line] * power[:line.shape[1]], axis=1, out=total[:, 1:])
    right, left = rows[:, length].astype(np.int64), rows[:, length + 1 + back].astype(np.int64)
    for j in range(back + 1):
        has = np.flatnonzero((j <= left) & (length - j <= right))
        if not len(has):
            continue
        h = (total[has, back - j + length] - total[has, back - j]) * inverse[back - j]
        order = np.lexsort((h, group[has]))
        g, w = group[has][order], h[order]
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]))))
        size = np.diff(np.append(first, len(order)))
        out[has[order], j] = np.repeat(np.minimum.reduceat(key[has][order], first), size)
    return out


def blocks(group: np.ndarray, limit: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups, as many as reach ``limit`` rows. Rows of a group stand together."""
    edges = np.append(starts_of_runs(group)[1:], len(group))
    lo = 0
    while lo < len(group):
        hi = int(edges[np.searchsorted(edges, min(lo + limit, len(group)))])
        yield lo, hi
        lo = hi


def earlier_windows(lcps: list[bytes], rest: list[bytes], key: np.ndarray, length: int) -> np.ndarray:
    """For each row of the front-coded runs, as bits, which of its windows a smaller key has.

    Windows are compared in blocks of whole groups: besides the rows, a range holds no more than
    their bits.
    """
    width = _width(length)
    runs = [(front_decode(x, y, width), x) for x, y in zip(lcps, rest, strict=True)]
    taken = np.fromiter((x for pair in merge(runs) for x in pair), np.int64, 2 * len(key)).reshape(-1, 2)
    # rows of one run come in their own order
    order = np.argsort(taken[:, 0], kind="stable")
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))  # merged position -> row in the joined runs
    flat = np.frombuffer(b"".join(r for rows, _ in runs for r in rows), np.uint8).reshape(-1, width)
    del runs
    key_, lcp = key[place], taken[:, 1]
    new = lcp < width
    new[:1] = True
    group = np.cumsum(lcp < ANCHOR)
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(key_, first) if len(first) else key_
    ends = np.append(first, len(key))
    mask = np.empty((len(key), _numbers(length)), np.int64)
    for lo, hi in blocks(group[first]):
        least = least_keys(flat[place[first[lo:hi]]], group[first[lo:hi]], lowest[lo:hi], length)
        rows = slice(ends[lo], ends[hi])
        earlier = least[of[rows] - lo] < key_[rows, None]
        for w in range(mask.shape[1]):
            some = earlier[:, 64 * w:64 * w + 64]
            bits = some @ (np.uint64(1) << np.arange(some.shape[1], dtype=np.uint64))
            mask[place[rows], w] = bits.astype(np.uint64).view(np.int64)
    return mask


def removed_runs(edge: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed bytes as flags, the document of each maximal run, and the kept bytes before each offset.

    ``edge`` has the strings that begin less those that end at each byte; its sums take its place.
    """
    gone = np.cumsum(edge, out=edge)[:-1] > 0
    start, end, of = spans(gone, offsets)
    before = np.concatenate(([0], np.cumsum(end - start)))  # of so many runs; none crosses an offset
    return gone, of, offsets - before[np.searchsorted(start, offsets)]


def _numbers(length: int) -> int:
    """A suffix's windows are bits of so many numbers."""
    return -(-(length - ANCHOR + 1) // 64)


class Chunk:
    """What a chunk knows of itself; the same in each of the three steps."""

    def __init__(self, table: pa.Table, length: int) -> None:
        order = np.argsort(table["doc"].to_numpy(), kind="stable")
        self.table = table.take(pa.array(order))
        self.key = self.table["doc"].to_numpy()
        self.data, self.offsets = texts(self.table["text"])
        self.length = length
        self.anchors = anchors(self.data, self.offsets, length)
        self.distinct, self.of, self.count = np.unique(
            self.anchors.hash, return_inverse=True, return_counts=True)
        low = np.full(len(self.distinct), cutting.NULL_KEY)
        high = np.full(len(self.distinct), -cutting.NULL_KEY)
        np.minimum.at(low, self.of, self.key[self.anchors.doc])
        np.maximum.at(high, self.of, self.key[self.anchors.doc])
        self.repeated = low < high

    def chosen(self, verdict: np.ndarray) -> tuple[Anchors, Anchors]:
        """Anchors that other documents have too: those that are sorted, and the hot ones."""
        a = self.anchors
        shared = (self.repeated | (verdict > 0))[self.of] if len(verdict) else np.zeros(0, bool)
        hot = (verdict == 2)[self.of] if len(verdict) else shared
        pick = lambda m: Anchors(a.doc[m], a.at[m], a.low[m], a.high[m], a.hash[m])
        return pick(shared & ~hot), pick(hot)

    def suffixes(self, a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct suffix rows, least key of each, and the suffix of each anchor."""
        rows = suffix_rows(self.data, a, self.length)
        order = sort_rows(rows)
        rows = rows[order]
        first = common_prefixes(rows) < rows.shape[1]
        number = np.cumsum(first) - 1
        of = np.empty(len(order), np.int64)
        of[order] = number
        key = np.full(int(first.sum()), cutting.NULL_KEY)
        np.minimum.at(key, of, self.key[a.doc])
        return rows[first], key, of

    def windows(self, a: Anchors) -> tuple[np.ndarray, ...]:
        """For hot anchors: start and document of every window, its number among the distinct
        ones, two hashes of each distinct one and the least key that has it."""
        size = a.high - a.low + 1
        start = np.repeat(a.low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = np.repeat(a.doc, size)
        step = np.arange(self.length)
        h = np.zeros((2, len(start)), np.uint64)
        for lo in range(0, len(start), SLICE // 8):
            part = slice(lo, lo + SLICE // 8)
            bytes_ = _BYTES[self.data[start[part][:, None] + step]]
            for k, ratio in enumerate((_RATIO, 0x9FB21C651E98DF25)):
                h[k, part] = mix((bytes_ * _powers(1 << 18, ratio)[:self.length]).sum(axis=1, dtype=np.uint64))
        order = np.lexsort((h[1], h[0]))
        s = h[:, order]
        first = np.concatenate(([True], (s[:, 1:] != s[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(first) - 1
        key = np.full(int(first.sum()), cutting.NULL_KEY)
        np.minimum.at(key, of, self.key[doc])
        return start, doc, of, s[0, first], s[1, first], key


def _verdict(replies: pa.Table, kind: str) -> np.ndarray:
    """Replies of one kind joined in order of their buckets."""
    mine = [(b, v) for k, b, v in zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "verdict")), strict=True)
            if k == kind]
    return np.concatenate([unpack_counts(v) for _, v in sorted(mine)]) if mine else np.zeros(0, np.int64)


def _by_range(sorted_hash: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    cuts = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    edges = [0, *np.searchsorted(sorted_hash, cuts).tolist(), len(sorted_hash)]
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]


def splitters(rows: DataFrame, n: int, length: int) -> list[bytes]:
    """n - 1 anchors that cut the anchors of a hash-chosen sample into equal parts.

    The sample has 2,000 documents, or four for each part, and 100,000 anchors or eight.
    """
    max_documents = max(2_000, 4 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in parts(batch["text"]):
                a = anchors(data, offsets, length)
                at = a.at[::max(1, len(a.at) // 20_000)]
                rows = data[at[:, None] + np.arange(ANCHOR)]
                yield pa.RecordBatch.from_pydict({"a": pa.array([r.tobytes() for r in rows], pa.binary())})

    if n < 2:
        return []
    sample = base.sampled(rows, max_documents).select("text").mapInArrow(base.tidy(run), "a binary")
    cut = F.xxhash64("a") % F.lit(max(1, -(-max_documents * 200 // max(100_000, 8 * n))))
    found = sorted(bytes(r["a"]) for r in sample.distinct().filter(cut == 0).collect())
    return [found[len(found) * i // n] for i in range(1, n)] if found else []


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50,
                     hot_count: int = 50_000, carry: bool | Sequence[str] = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of every whole text (UTF-8; null: empty).

    Every byte covered by a string of ``length`` bytes that also starts in a document with
    a smaller key is removed; strings are those of the input. Rows that repeat a key are one
    document's and do not remove each other's bytes. A null key stands above all others.
    ``carry`` adds ``row``, a struct of all columns of the document or of those it names (the text
    among them is exchanged a second time), and ``remaining``, the kept bytes as text without the
    fragments of characters that a cut leaves.
    """
    if not ANCHOR <= length <= 120:
        raise ValueError(f"length must be {ANCHOR} to 120")
    spark = docs.sparkSession
    base.ship(spark)
    names = docs.columns if carry is True else list(carry or ())
    carried = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]
    keyed = docs.select(*cutting.key_and_text(key, text), *carried)
    rows = keyed.select("doc", "text")
    size = base.text_bytes(rows)
    n_chunks = base.buckets(size, base.chunk_bytes(size))
    n_buckets = base.buckets(size, 4 * base.chunk_bytes(size))
    # ranges are finer: repeated text gathers in some of them
    n_ranges = base.buckets(size, base.chunk_bytes(size))
    cuts = np.array(splitters(rows, n_ranges, length), f"S{ANCHOR}")
    n_words = _numbers(length)
    number = F.pmod(F.xxhash64("doc", "text"), F.lit(n_chunks)).cast("int")
    chunks = keyed.withColumn("chunk", number)

    def offer(table: pa.Table) -> pa.Table:
        c = Chunk(table, length)
        out = [(table["chunk"][0].as_py(), b, pack_sorted(c.distinct[lo:hi]), pack_counts(c.count[lo:hi]))
               for b, lo, hi in _by_range(c.distinct, n_buckets)]
        return _table(out, OFFER)

    def judge(table: pa.Table) -> pa.Table:
        hashes_ = [unpack_sorted(x) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([unpack_counts(x) for x in table["counts"].to_pylist()])
        distinct, of, chunks_ = np.unique(np.concatenate(hashes_), return_inverse=True, return_counts=True)
        total = np.bincount(of, counts, len(distinct))
        verdict = np.where(total > hot_count, 2, (chunks_ > 1).astype(np.int64))[of]
        split = np.split(verdict, np.cumsum([len(x) for x in hashes_])[:-1])
        return _table([(c, "anchor", b, pack_counts(v)) for c, b, v in zip(
            table["chunk"].to_pylist(), table["bucket"].to_pylist(), split, strict=True)], REPLY)

    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], RUN)
        c, out = Chunk(docs, length), []
        chunk = docs["chunk"][0].as_py()
        cold, hot = c.chosen(_verdict(replies, "anchor"))
        rows, least, _ = c.suffixes(cold)
        bucket = np.searchsorted(cuts, _first_bytes(rows), side="right")
        edges = [0, *np.searchsorted(bucket, np.arange(1, n_ranges)).tolist(), len(bucket)]
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if hi > lo:
                out.append((chunk, "suffix", b, *front_code(rows[lo:hi]), pack_counts(least[lo:hi])))
        _, _, _, one, two, least = c.windows(hot)
        for b, lo, hi in _by_range(one, n_buckets):
            out.append((chunk, "window", b, pack_sorted(one[lo:hi]), two[lo:hi].tobytes(), pack_counts(least[lo:hi])))
        return _table(out, RUN)

    def answer(table: pa.Table) -> pa.Table:
        least = [unpack_counts(x) for x in table["least"].to_pylist()]
        kind, b = table["kind"][0].as_py(), table["bucket"][0].as_py()
        sizes = [len(x) for x in least]
        key = np.concatenate(least)
        if kind == "window":
            one = np.concatenate([unpack_sorted(x) for x in table["lcps"].to_pylist()])
            two = np.concatenate([np.frombuffer(x, np.uint64) for x in table["rest"].to_pylist()])
            order = np.lexsort((two, one))
            o, t = one[order], two[order]
            first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (t[1:] != t[:-1]))))
            low = np.empty(len(key), np.int64)
            low[order] = np.repeat(np.minimum.reduceat(key[order], first), np.diff(np.append(first, len(key))))
            mask = (low < key).astype(np.int64)[:, None]
        else:
            mask = earlier_windows(table["lcps"].to_pylist(), table["rest"].to_pylist(), key, length)
        split = np.split(mask, np.cumsum(sizes)[:-1])
        return _table([(c, kind, b, pack_counts(v.ravel())) for c, v in zip(
            table["chunk"].to_pylist(), split, strict=True)], REPLY)

    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], CUT)
        c = Chunk(docs, length)
        cold, hot = c.chosen(_verdict(replies, "anchor"))
        edge = np.zeros(len(c.data) + 1, np.int32)

        def remove(start: np.ndarray, end: np.ndarray) -> None:
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)

        least, of = c.suffixes(cold)[1:]
        if len(of):
            mask = _verdict(replies, "suffix").view(np.uint64).reshape(-1, n_words)[of]
            later = c.key[cold.doc] > least[of]  # the chunk holds the same suffix under a smaller key
            remove(cold.low[later], cold.high[later] + length)
            for j in range(length - ANCHOR + 1):
                hit = ~later & (mask[:, j // 64] >> np.uint64(j % 64) & np.uint64(1) > 0)
                hit &= (cold.at - j >= cold.low) & (cold.at - j <= cold.high)
                remove(cold.at[hit] - j, cold.at[hit] - j + length)
        start, doc, of, _, _, least = c.windows(hot)
        if len(of):
            hit = (c.key[doc] > least[of]) | (_verdict(replies, "window")[of] > 0)
            remove(start[hit], start[hit] + length)
        gone, of, total = removed_runs(edge, c.offsets)
        n = len(c.key)
        kept = c.data[~gone].tobytes()
        n_bytes = np.diff(c.offsets)
        left = [kept[a:b] for a, b in zip(total, total[1:], strict=False)]
        out = pa.Table.from_pydict({
            "doc": c.key, "n_bytes": n_bytes, "n_removed": n_bytes - np.diff(total),
            "n_spans": np.bincount(of, minlength=n).astype(np.int64), "kept": pa.array(left, pa.binary())}, schema=CUT)
        if carry:
            text_ = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
            for name in schema_of_row.names:
                out = out.append_column(name, c.table[name])
            out = out.append_column("remaining", text_)
        return out

    offers = chunks.groupBy("chunk").applyInArrow(base.tidy(offer), _ddl(OFFER))
    verdicts = offers.groupBy("bucket").applyInArrow(base.tidy(judge), _ddl(REPLY))
    runs = chunks.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(base.tidy(send), _ddl(RUN))
    answers = runs.groupBy("kind", "bucket").applyInArrow(base.tidy(answer), _ddl(REPLY))
    replies = verdicts.unionByName(answers)
    result = T.StructType.fromDDL(_ddl(CUT))
    schema_of_row = T.StructType([f for f in keyed.schema if f.name.startswith("_")])
    if carry:
        result = T.StructType([*result, *schema_of_row, T.StructField("remaining", T.StringType())])
    out = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(base.tidy(cut), result)
    row = F.struct(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names))).alias("row")
    return out.select(F.expr(f"nullif(doc, {cutting.NULL_KEY}L)").alias("doc_id"), "n_bytes", "n_removed",
                      "n_spans", "kept", *([row, "remaining"] if carry else []))


OFFER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
REPLY = pa.schema([("chunk", pa.int32()), ("kind", pa.string()), ("bucket", pa.int32()), ("verdict", pa.binary())])
RUN = pa.schema([("chunk", pa.int32()), ("kind", pa.string()), ("bucket", pa.int32()), ("lcps", pa.binary()),
                 ("rest", pa.binary()), ("least", pa.binary())])
CUT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first_bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :ANCHOR]).view(f"S{ANCHOR}").ravel()
