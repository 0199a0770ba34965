"""Phrases and their counts against plain Python, and filters against what went into them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest
from helpers_llm import awkward, collected, documents, some_texts

from tidecast.llm import base, collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def expected(rows, least, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in candidates.items():
        longer = (f for (m, v), f in candidates.items() if m == lang and len(v) > len(w) and 100 * f >= 80 * a
                  and any(v[i:i + len(w)] == w for i in range(len(v))))
        if next(longer, None) is None:
            score, k = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, x in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def got(docs, *args):
    return sorted(collected(collocations.collocations(docs, *args).select(*COLUMNS)))


def pairs(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


@pytest.mark.parametrize("shard", [300, 4 << 20])
def test_awkward_rows_in_small_and_large_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(base, "chunk_bytes", lambda n: shard)
    texts = [t.replace("c", ". ").replace("h", "\tH") for t in some_texts(seed=7, n=50, vocabulary=25)]
    docs = awkward(spark, texts)
    wanted = expected(pairs(docs), 4)
    assert got(docs, 4) == wanted
    assert {len(r[2].split(" ")) for r in wanted} == {2, 3, 4} and len({r[0] for r in wanted}) == 3


def test_repeats_ties_and_a_small_top(spark):
    rng = random.Random(8)
    texts = ["one two three four five"] * 200 + ["x x x x x x x"] * 30 + [
        " ".join(rng.choice("abc") for _ in range(30)) for _ in range(150)]
    docs = documents(spark, texts)
    for top in (1, 7, 2000):
        assert got(docs, 30, top) == expected(pairs(docs), 30, top)


def test_a_null_language_joins_the_undetermined(spark):
    docs = documents(spark, ["New York. New  York"] * 20).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, None).otherwise("und"))
    assert got(docs) == [("und", 1, "new york", 40, 40, 40, 80, 1000000)]


def test_nothing_to_find(spark):
    assert got(documents(spark, [])) == []
    assert got(documents(spark, ["", None, "only a few words", ".;"])) == []


@pytest.mark.parametrize("width", [2, 4, 16, 18, 22, 30, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_lose_nothing(width, n):
    rng = np.random.default_rng(width)
    ids = rng.integers(1, min(1 << width, 60), (n, 4000), dtype=np.uint64)
    ids[:, ::7] = rng.integers((1 << width) - 2, 1 << width, ids[:, ::7].shape, dtype=np.uint64)
    half = n * width // 2
    number = collocations.joined(*collocations.permuted(*collocations.packed(list(ids), width), half), half)
    order, first = collocations.ordered(*number)
    high, low = (x[order[first]] for x in number)
    count = np.diff(np.append(first, len(order)))
    got_ = []
    bucket = collocations.bucketed(high, half, 3)
    assert (np.diff(bucket) >= 0).all() and bucket.max() < 3
    for b in range(3):
        own = bucket == b
        if own.any():
            q = min(9, 2 * half)
            packed = collocations.quotient_filter(high[own], low[own], count[own], half, q)
            h, x, c = collocations.entries(packed, half)
            words = collocations.unpacked(*collocations.restored(*collocations.halves(h, x, half), half), n, width)
            got_ += zip(*(w.tolist() for w in words), c.tolist(), strict=True)
    assert {x[:-1]: x[-1] for x in got_} == Counter(zip(*ids.tolist(), strict=True)) and len(got_) == len(first)


def test_equal_high_parts_are_told_apart():
    high, low = np.array([5, 5, 1, 5, 5], np.uint64), np.array([2, 1, 0, 2, 1], np.uint64)
    order, first = collocations.ordered(high, low)
    assert [(int(high[i]), int(low[i])) for i in order[first]] == [(1, 0), (5, 1), (5, 2)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 61
    words = spark.createDataFrame([("en", "p", big + 7, 1), ("en", "q", big + 1, 2)], "lang string, word string, f long, id long")
    grams = spark.createDataFrame([(1, 2, 0, 0, big)], "a long, b long, c long, d long, f long")
    row = collocations.scored(words, grams).first()
    assert row.score == 2000000 * big // (2 * big + 8)
