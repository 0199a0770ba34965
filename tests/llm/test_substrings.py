import random
import tracemalloc

import numpy as np
import pytest
from helpers_llm import awkward, collected, documents, some_texts

from tidecast.llm import base, chunking, cutting, suffixes


def removed_by_earlier(rows, length):
    """Every byte covered by a string that also starts under a smaller key, looked up in one dictionary."""
    first = {}
    for k, t in rows:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            first[w] = min(first.get(w, k), k)
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < k:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        yield k, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)


def rows_of(docs):
    return [(cutting.NULL_KEY if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode())
            for r in docs.select("doc_id", "text").collect()]


def check(docs, **kwargs):
    got = sorted((cutting.NULL_KEY if r[0] is None else r[0], *r[1:])
                 for r in collected(suffixes.dedup_substrings(docs, **kwargs)))
    want = sorted(removed_by_earlier(rows_of(docs), kwargs.get("length", 50)))
    assert got == want
    return want


@pytest.mark.parametrize("length", [50, 24, 16])
def test_substrings_match_brute_force(spark, length):
    texts = some_texts(length, 150) + ["a" * 400, "a" * 200, "ab" * 200, "\0" * 120, "x" + "\0" * 99]
    want = check(documents(spark, texts, 5), length=length)
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("length", [79, 80, 120])
def test_long_strings_repeated_in_other_chunks(spark, monkeypatch, length):
    monkeypatch.setattr(base, "chunk_bytes", lambda n: 2_000)
    monkeypatch.setattr(base, "buckets", lambda n, each: 7)
    rng = random.Random(length)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(length + n)) for n in (0, 1, 3, 40) for _ in range(5)]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + s + rng.choice("xyz") * 3
             for s in shared * 2]
    want = check(documents(spark, texts, 5), length=length)
    assert sum(r[2] > 0 for r in want) == len(shared)


def test_many_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(base, "chunk_bytes", lambda n: 2_000)
    monkeypatch.setattr(base, "buckets", lambda n, each: 7)
    check(documents(spark, some_texts(3, 150), 5))


def test_hot_anchors_take_the_window_route(spark, monkeypatch):
    monkeypatch.setattr(base, "buckets", lambda n, each: 3)
    check(documents(spark, some_texts(5, 120), 5), hot_count=4)


def test_awkward_rows(spark):
    docs = awkward(spark, some_texts(6, 30))
    check(docs)
    cut = suffixes.dedup_substrings(docs, carry=True)
    assert sorted(map(str, cut.select("row.*").collect())) == sorted(map(str, docs.collect()))
    for r in cut.collect():
        assert r["remaining"] == bytes(r["kept"]).decode("utf-8", "ignore")
    assert suffixes.dedup_substrings(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_keeps_prefix_lengths():
    rng = random.Random(2)
    for _ in range(300):
        runs = []
        for _ in range(rng.randint(1, 9)):
            rows = sorted({bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(1, 20))})
            runs.append((rows, bytes([0] + [prefix(a, b) for a, b in zip(rows, rows[1:], strict=False)])))
        got = list(suffixes.merge(runs))
        heads = [iter(rows) for rows, _ in runs]
        out = [next(heads[x]) for x, _ in got]
        assert out == sorted(r for rows, _ in runs for r in rows)
        assert [n for _, n in got][1:] == [prefix(a, b) for a, b in zip(out, out[1:], strict=False)]


def prefix(a, b):
    return next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def test_front_coding_round_trip():
    rows = np.unique(np.random.default_rng(1).integers(97, 99, (60, 16), np.uint8), axis=0)
    rows = rows[suffixes.sort_rows(rows)]
    lcps, rest = suffixes.front_code(rows)
    assert suffixes.front_decode(lcps, rest, 16) == [r.tobytes() for r in rows]
    assert len(rest) < rows.size


def runs_of_one_range(length, n, n_groups):
    rng = np.random.default_rng(length)
    text = rng.integers(97, 99, (n, 2 * length), np.uint8)
    # few anchors, and often the same bytes after them
    text[:, length:length + 16] = rng.integers(97, 99, (n_groups, 16), np.uint8)[rng.integers(0, n_groups, n)]
    text[:300:3, length:] = text[0, length:]
    text[:300:2, length - 3:] = text[1, length - 3:]
    key = rng.integers(0, 40, n)
    at = np.arange(n) * 2 * length + length
    a = suffixes.Anchors(np.arange(n), at, at - rng.integers(0, length - 15, n), at + rng.integers(0, 1, n), at)
    rows = suffixes.suffix_rows(text.ravel(), a, length)
    runs = []
    for part in np.array_split(np.arange(n), 3):
        order = part[suffixes.sort_rows(rows[part])]
        first = suffixes.common_prefixes(rows[order]) < rows.shape[1]
        runs.append((rows[order][first], np.minimum.reduceat(key[order], np.flatnonzero(first))))
    return runs


@pytest.mark.parametrize("length, limit", [(50, 7), (50, 1 << 13), (100, 50)])
def test_windows_of_a_range_are_judged_in_blocks(monkeypatch, length, limit):
    blocks = suffixes.blocks
    monkeypatch.setattr(suffixes, "blocks", lambda group: blocks(group, limit))
    runs = runs_of_one_range(length, 400, 20)
    back = length - 16
    found, least = [], {}
    for rows, key in runs:
        for r, k in zip(rows, key.tolist(), strict=True):
            line = r[length + 1:length + 1 + back][::-1].tobytes() + r[:length].tobytes()
            windows = {j: line[back - j:back - j + length] for j in range(back + 1)
                       if j <= r[length + 1 + back] and length - j <= r[length]}
            found.append((k, windows))
            for j, w in windows.items():
                least[j, w] = min(least.get((j, w), k), k)
    coded = [suffixes.front_code(rows) for rows, _ in runs]
    mask = suffixes.earlier_windows([x for x, _ in coded], [y for _, y in coded],
                                    np.concatenate([key for _, key in runs]), length).view(np.uint64)
    hits = 0
    for bits, (k, windows) in zip(mask, found, strict=True):
        for j, w in windows.items():
            assert (int(bits[j // 64]) >> j % 64 & 1) == (least[j, w] < k)
            hits += least[j, w] < k
    assert hits > 100


def test_a_range_does_not_hold_all_its_windows():
    runs = runs_of_one_range(50, 120_000, 30_000)
    coded = [suffixes.front_code(rows) for rows, _ in runs]
    key = np.concatenate([key for _, key in runs])
    tracemalloc.start()
    suffixes.earlier_windows([x for x, _ in coded], [y for _, y in coded], key, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 * len(key)  # 1,200 and more bytes a row if all windows are compared at once


def test_every_window_has_an_anchor_that_depends_on_it_alone():
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcd ") for _ in range(90))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) + passage for n in (0, 7, 33, 200)]
    seen = []
    for t in texts:
        data, offsets = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        a = suffixes.anchors(data, offsets, 50)
        window = {}
        for at, low, high in zip(a.at, a.low, a.high, strict=True):
            for i in range(low, high + 1):
                assert i <= at <= i + 34
                window[i] = at - i
        assert sorted(window) == list(range(len(t) - 49))
        seen.append([window[len(t) - 90 + i] for i in range(41)])
    assert all(s == seen[0] for s in seen)


def rolled(b):
    gear = [int(x) for x in chunking.GEAR]
    out = []
    for i in range(len(b)):
        h = sum(gear[b[i - j]] << j for j in range(min(16, i + 1)))
        out.append((h & (2**64 - 1)) >> 24 & 0xFFFFFFFF)
    return out


def test_removed_runs_hold_no_number_per_byte():
    rng = np.random.default_rng(4)
    offsets = np.array([0, 0, 7, 40, 40, 200, 300])
    edge = np.zeros(301, np.int32)
    for lo, hi in ((0, 7), (7, 20), (15, 40), (60, 61), (199, 200), (200, 260), (299, 300)):
        edge[lo] += 1
        edge[hi] -= 1
    flags = np.cumsum(edge[:-1]) > 0
    runs = [d for d, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)) for i in range(a, b)
            if flags[i] and (i == a or not flags[i - 1])]
    gone, of, total = suffixes.removed_runs(edge.copy(), offsets)
    assert (gone == flags).all() and of.tolist() == runs
    assert total.tolist() == [int((~flags[:x]).sum()) for x in offsets]
    assert [x.tolist() for x in suffixes.removed_runs(np.zeros(1, np.int32), np.zeros(1, np.int64))] == [[], [], [0]]
    n = 1 << 20
    edge = np.zeros(n + 1, np.int32)
    at = rng.choice(n - 60, 3000, replace=False)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 50, -1)
    tracemalloc.start()
    suffixes.removed_runs(edge, np.arange(0, n + 1, 1 << 12))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * n  # flags and their edges; sums as 64-bit numbers would be eight bytes a byte


def plain_chunks(b, reach=12, longest=1024):
    h, ends = rolled(b), []
    for i in range(reach + 15, len(b) - reach):
        if h[i] < min(h[i - reach:i]) and h[i] <= min(h[i + 1:i + reach + 1]):
            ends.append(i + 1)
    start = 0
    for end in [*ends, len(b)]:
        while end - start > longest:
            yield b[start:start + longest]
            start += longest
        yield b[start:end]
        start = end


def first_chunks(rows, least=48):
    seen = set()
    for k, t in sorted(rows):
        kept, run = b"", b""
        for c in [*plain_chunks(t), None] if t else ():
            if c in seen:
                run += c
                continue
            kept += (run if len(run) < least else b"") + (c or b"")
            run = b""
            seen.add(c)
        seen.discard(None)
        yield k, len(t), len(t) - len(kept), kept


def test_chunks_match_brute_force(spark):
    texts = some_texts(8, 150) + ["", None, "a" * 5000, "a" * 5000, "ab" * 2000]
    docs = documents(spark, texts, 5)
    got = sorted((r[0], r[1], r[2], r[4]) for r in collected(chunking.dedup_chunks(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept")))
    want = sorted(first_chunks(rows_of(docs)))
    assert got == want and sum(r[2] > 0 for r in want) > 20


def test_insertion_moves_only_chunks_nearby():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    other = text[:1500] + b"inserted words" + text[1500:]

    def of(t):
        data, offsets = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        start, end, _ = chunking.chunks(data, offsets)
        return {t[a:b] for a, b in zip(start, end, strict=True)}

    assert len(of(text) - of(other)) <= 4


def test_chunks_of_awkward_rows(spark):
    docs = awkward(spark, some_texts(6, 30))
    rows = chunking.dedup_chunks(docs)
    assert rows.count() == docs.count()
    for r in rows.collect():
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"])
    assert chunking.dedup_chunks(docs.limit(0)).count() == 0


def test_spans_are_cut_from_their_own_text(spark):
    docs = cutting.keyed(spark.createDataFrame(
        [(1, "abcdef"), (1, "ghijkl"), (2, "abcdef"), (1, "abcdef")], "doc_id long, text string"))
    docs = cutting.dealt(docs, 3)
    one = docs.filter("doc = 1 AND text = 'abcdef'").first()
    twice = lambda x: np.array([x, x])
    packed = cutting.pack(twice(one["chunk"]), twice(1), twice(one["mark"]), np.array([3, 1]), np.array([5, 2]))
    removed = spark.createDataFrame(packed.to_pandas(), cutting.REMOVED)
    got = sorted((r["doc_id"], bytes(r["kept"]), r["n_spans"]) for r in cutting.cut(docs, removed).collect())
    assert got == [(1, b"acf", 2), (1, b"acf", 2), (1, b"ghijkl", 0), (2, b"abcdef", 0)]
    got = sorted(bytes(r["kept"]) for r in cutting.cut(docs, removed, least=2).collect())
    assert got == [b"abcdef", b"abcf", b"abcf", b"ghijkl"]
