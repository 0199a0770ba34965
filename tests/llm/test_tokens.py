import hashlib
import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import AWKWARD, awkward, documents, some_texts
from tokenizers import Tokenizer

from tidecast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spec():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def fuzz(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", "aa", " ", "  ", "\n", "the", "th", "é", "日本", "\U0001f600", "1", "23", "'s", "'ll", "\t", "\x85",
             "　", "\x1c", "aaaa", "----", "....", "=", "ab", "ing", "  \n", "​", "ſ", "ǅ", "٣", "½",
             "\xa0", "\0", "'", "́", "\r\n", "____", "<|endoftext|>", "<|endof", "�"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library(spec, library):
    texts = fuzz(1, 3000) + [t or "" for t in AWKWARD] + some_texts(2, 50)
    encoder = bpe.Encoder(spec)
    for t, mine, ref in zip(texts, encoder(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == packed(ref.ids), t
        assert encoder.decode(mine) == library.decode(ref.ids, skip_special_tokens=False) == t


def test_ascii_texts_are_cut_as_the_library_does(spec, library):
    rng = random.Random(8)
    parts = [chr(c) for c in range(128)] + ["  ", "\r\n", "'s", "'re", " 12", " ab", "'LL", "\x1c\x1d ", " \x0b", "n't "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encoder = bpe.Encoder(spec)
    encoder.plain = encoder.strict = None
    for t, mine, ref in zip(texts, encoder(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == packed(ref.ids), t


def test_texts_of_a_slice_are_decoded_together(spec, library):
    texts = [*fuzz(6, 200), "", "<|endoftext|>", *some_texts(6, 20), ""]
    encoder = bpe.Encoder(spec)
    ids = encoder(texts)
    assert encoder.decoded(ids) == texts
    assert encoder([]) == [] and encoder.decoded([]) == [] and encoder.decoded([b"", b""]) == ["", ""]
    cut = [packed(library.encode(t, add_special_tokens=False).ids[:n]) for t, n in (("日本日本é", 1), ("a日", 2), ("x😀", 2))]
    assert encoder.decoded(cut) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in cut]


def test_letters_and_numbers_of_all_planes(spec, library):
    rng = random.Random(5)
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)}" for c in [
        *range(0x500, 0xD800, 7), *range(0xE000, 0x34000, 11), *range(0x3D000, 0x3FD00, 50)]]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x3FFFF)]))
                      for _ in range(30)) for _ in range(2000)]
    for t, mine, ref in zip(texts, bpe.Encoder(spec)(texts),
                            library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == packed(ref.ids), t


def test_whole_test_table_equals_the_library(spark, spec, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = bpe.encode(docs, spec, decoded=True).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert bytes(r["ids"]) == packed(library.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert r["decoded"] == text[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"])


def merged_by_rank(word, ranks):
    """Plain byte-pair encoding: merge the pair of least rank, leftmost first, until there is none."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                    if (a, b) in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def random_merges(seed):
    """A vocabulary over few letters, with overlaps of a token with itself and merges no text reaches."""
    rng = random.Random(seed)
    labels, merges, ranks = [bytes([b]) for b in range(256)], [], {}
    pool = [ord(c) for c in "abc"]
    while len(merges) < 25:
        a, b = rng.choice(pool), rng.choice(pool)
        ab = labels[a] + labels[b]
        if (labels[a], labels[b]) in ranks or ab in labels or len(ab) > 9:
            continue
        labels.append(ab)
        merges.append((a, b, len(labels) - 1))
        ranks[labels[a], labels[b]] = len(ranks)
        pool.append(len(labels) - 1)
    return bpe.Merges(tuple(labels), tuple(merges), (), f"random {seed}"), ranks


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_merging_by_rank(seed):
    spec, ranks = random_merges(seed)
    automaton = bpe.Automaton(spec)
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(200)}
                   | {b"a" * n for n in range(1, 20)})
    for w, ids in zip(words, automaton.encode(words), strict=True):
        assert [spec.labels[i] for i in ids] == merged_by_rank(w, ranks)


def test_an_automaton_is_small_and_shrinks(spec, library):
    texts = fuzz(7, 400) + some_texts(7, 60)
    words = sorted({w.encode() for t in texts for w in bpe.Encoder(spec).split(t)})
    tracemalloc.start()
    automaton = bpe.Automaton(spec)
    built = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert built < 23 << 20
    ids = list(automaton.encode(words))
    step = dict(automaton.step)
    assert automaton.table and len(step) > automaton.cells
    automaton.shrink(len(step))
    assert automaton.table and automaton.step == step
    automaton.shrink(0)
    assert not automaton.table and len(automaton.step) == automaton.cells
    assert list(automaton.step.items()) == list(step.items())[:automaton.cells]
    assert list(automaton.encode(words)) == ids


def test_awkward_rows_and_round_trip(spark, spec):
    docs = awkward(spark)
    tokens = bpe.encode(docs, spec)
    assert tokens.count() == docs.count()
    back = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(tokens, spec).collect()), key=str)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    assert bpe.encode(docs.limit(0), spec).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(none, spec).first()["text"] is None


def test_long_words_take_linear_steps(spec):
    text = "x" * 200_000 + " " * 20_000 + "ab" * 50_000
    encoder = bpe.Encoder(spec)
    ids = encoder([text])[0]
    assert encoder.decode(ids) == text
    assert np.frombuffer(ids, "<u4").max() < len(spec.labels)


def test_digests_of_the_query(spark, spec):
    docs = documents(spark, ["the cat", None])
    from tidecast.llm.catalog import QUERIES
    import tidecast.llm.base as base
    original = base.read
    base.read = lambda *_: docs
    try:
        rows = {r["doc_id"]: r for r in QUERIES["op7_byte_bpe"](spark, "").collect()}
    finally:
        base.read = original
    assert rows[0]["decoded_sha256"] == hashlib.sha256(b"the cat").hexdigest()
    assert rows[0]["ids_sha256"] == hashlib.sha256(bpe.Encoder(spec)(["the cat"])[0]).hexdigest()
    assert rows[1]["ids_sha256"] == rows[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
