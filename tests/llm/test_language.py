import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import awkward

from tidecast.llm import base, langid


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:], strict=False)]


@pytest.fixture(scope="module")
def small():
    pieces = [b" a", b"a", b"b", b"ab", b"ba", b" ab", b"abb", b" ", "é".encode()]
    prob = np.zeros((257 + len(pieces), 2))
    prob[257:] = np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T
    return langid.Pieces(pieces), langid.normalised(prob, 1e-9), pieces


def test_forward_sums_all_segmentations(small):
    table, prob, pieces = small
    arc = {p: 257 + i for i, p in enumerate(pieces)}
    words = [b" abba", b"ab", b" a", b"zab", " éab".encode(), b"abbabbaabb"]
    got = langid.log_likelihoods(words, table, prob)
    for w, ll in zip(words, got, strict=True):
        for col in range(2):
            total = sum(math.prod(
                prob[arc[p], col] if p in arc else (prob[p[0] + 1, col] if len(p) == 1 else 0.0) for p in seg)
                for seg in segmentations(w))
            assert ll[col] == pytest.approx(math.log(total), rel=1e-9)


def plain(word, arc, prob, col):
    """The same sum by a plain pass over the bytes, in logarithms."""
    ahead = [0.0]
    for j in range(1, len(word) + 1):
        terms = []
        for i in range(max(0, j - 48), j):
            p = word[i:j]
            x = prob[arc[p], col] if p in arc else (prob[p[0] + 1, col] if len(p) == 1 else 0.0)
            if x > 0:
                terms.append(ahead[i] + math.log(x))
        top = max(terms)
        ahead.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return ahead[-1]


@pytest.mark.parametrize("window", [8192, 97])
def test_long_words_are_summed_whole(small, monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    table, prob, pieces = small
    arc = {p: 257 + i for i, p in enumerate(pieces)}
    words = [b" " + b"ab" * 100, b" " + b"abba" * 60 + b"z" * 90, " é".encode() + b"ba" * 300, ("é" * 150).encode(),
             b" " + b"a" * 63, b" " + b"a" * 64, b"z" * 200]
    got = langid.log_likelihoods(words, table, prob)
    for w, ll in zip(words, got, strict=True):
        assert b"".join(langid.cut(w, table)) == w
        for col in range(2):
            assert ll[col] == pytest.approx(plain(w, arc, prob, col), rel=1e-9)


def test_texts_without_spaces_are_summed_whole():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    table = langid.Pieces(pieces)
    arc = {p: 257 + i for i, p in enumerate(pieces)}
    prob = langid.normalised(np.random.default_rng(5).random((table.size, 2)), 0.1)
    words = [(" " + "日本語の文章と中文的句子" * 12).encode(), " ภาษาไทยไม่มีช่องว่าง".encode() * 6,
             b" " + b"https://example.org/a-long-path?of=things&and=more" * 4]
    got = langid.log_likelihoods(words, table, prob)
    for w, ll in zip(words, got, strict=True):
        for col in range(2):
            assert ll[col] == pytest.approx(plain(w, arc, prob, col), rel=1e-9)


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½", "²①Ⅷ", "12", "a", "字", "ª", "e\u0301"])],
                                 "doc_id long, text string, lang string")
    model = langid.train(docs, [b"a", b" "])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en", 5: "en", 6: "en"}


def test_expected_counts_are_posterior_counts(small):
    table, prob, pieces = small
    arc = {p: 257 + i for i, p in enumerate(pieces)}
    got = langid.expected_counts([b" abab"], np.array([2.0]), np.array([1]), table, prob)
    weight = {}
    for seg in segmentations(b" abab"):
        weight[tuple(seg)] = math.prod(prob[arc[p], 1] if p in arc else 0.0 for p in seg)
    total = sum(weight.values())
    for p in (b"ab", b" a", b"b", b" ab"):
        want = 2 * sum(w * seg.count(p) for seg, w in weight.items()) / total
        assert got[arc[p], 1] == pytest.approx(want, abs=1e-9)
    assert got[:, 0].sum() == 0


def test_held_out_accuracy(spark):
    docs = base.read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.filter(~base.held_out()), langid.vocabulary(
        public_tokenizers.path("piece_bpe_32k.model")), max_documents=300)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(base.held_out())
    right = [r["lang_pred"] == r["lang"] for r in rows.collect()]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark, ["the cat is on the mat"] * 3)
    pieces = [b" the", b"c", b"a", b"t", b" "]
    model = langid.train(docs, pieces)
    assert model.languages == ["de", "en"]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "und"}
    letters = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 13, 15)}
    assert set(letters.values()) == {"und"}
    empty = docs.limit(0)
    assert langid.train(empty, pieces) is None
    assert langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
