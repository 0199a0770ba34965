import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import AWKWARD, SPACE, awkward, some_texts

from tidecast.llm import base, columnar


def buffers(texts):
    return columnar.texts(pa.array(texts, pa.string()))


def test_held_out_is_crc32_of_the_key_as_text(spark):
    rows = spark.range(-50, 2000).withColumnRenamed("id", "doc_id").select("doc_id", base.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    none = spark.createDataFrame([(None,)], "doc_id long").select(base.held_out().alias("h")).first()
    assert none["h"] is False


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    first = sorted(r[0] for r in base.sampled(df, 1_000).collect())
    again = sorted(r[0] for r in base.sampled(df.repartition(7), 1_000).collect())
    assert first == again and 800 < len(first) <= 1000
    assert base.sampled(df, 20_000).count() == 20_000


@pytest.mark.parametrize("hot", ["key", "null", "row"])
def test_sample_holds_its_bound_with_a_third_of_all_rows_under_one_key(spark, hot):
    rows = [(i, f"t{i}") for i in range(6000)]
    rows += [(None if hot == "null" else 7, "t" if hot == "row" else f"x{i}") for i in range(3000)]
    got = base.sampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 900).collect()
    assert 800 < len(got) <= 900
    of_key = sum(r["doc_id"] in (None, 7) and r["text"] != "t7" for r in got)
    assert 230 < of_key < 370
    assert hot == "row" or len(set(got)) == len(got)


def test_sample_by_group_keeps_rare_groups_whole(spark):
    rows = [("en", i) for i in range(5000)] + [("de", i) for i in range(3000)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, n long")
    got = Counter(r["lang"] for r in base.sampled(df, 900, "lang").collect())
    assert got[None] == 40 and 230 < got["en"] <= 330 and 230 < got["de"] <= 330


def test_chunks_grow_with_the_corpus_but_slower():
    sizes = [base.chunk_bytes(10**k) for k in range(6, 16)]
    assert sizes == sorted(sizes) and sizes[0] == 4 << 20 and sizes[-1] == 64 << 20
    assert base.buckets(0, 100) == 1 and base.buckets(101, 100) == 2


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in AWKWARD] + some_texts(3, 30)
    data, offsets = buffers(texts)
    start, end, doc = columnar.words(data, offsets)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc, strict=True):
        got[d].append(bytes(data[a:b]).decode())
    assert got == [re.findall(SPACE, t) for t in texts]


def test_hashes_depend_on_content_alone(monkeypatch):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("ab\0c") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    data, offsets = buffers(texts)
    start, end, _ = columnar.words(data, offsets)
    whole = columnar.hashes(data, start, end)
    monkeypatch.setattr(columnar, "BLOCK", 37)
    assert (columnar.hashes(data, start, end) == whole).all()
    words = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
    assert len(set(zip(words, whole.tolist(), strict=True))) == len(set(words)) == len(set(whole.tolist()))


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (columnar.unpack_sorted(columnar.pack_sorted(values)) == values).all()
        counts = rng.integers(-5, 2**40, n)
        assert (columnar.unpack_counts(columnar.pack_counts(counts)) == counts).all()


def test_slices_hold_whole_documents():
    offsets = np.array([0, 5, 5, 20, 21, 100, 101])
    got = list(columnar.slices(offsets, 20))
    assert [lo for lo, _ in got] == [0, *[hi for _, hi in got[:-1]]] and got[-1][1] == 6
    for lo, hi in got:
        assert hi == lo + 1 or offsets[hi] - offsets[lo] <= 20
    assert list(columnar.slices(np.array([0]))) == []


def test_sliced_columns_and_nulls():
    column = pa.array(["ab", None, "c", "def"]).slice(1)
    data, offsets = columnar.texts(column)
    assert bytes(data) == b"cdef" and offsets.tolist() == [0, 0, 1, 4]
    data, offsets = columnar.texts(pa.chunked_array([["a"], ["b", None]]))
    assert bytes(data) == b"ab" and offsets.tolist() == [0, 1, 2, 2]


def test_documents_take_only_key_and_text(spark):
    docs = awkward(spark)
    assert base.documents(docs).columns == ["doc_id", "text"]
    assert base.text_bytes(docs.limit(0)) == 0
