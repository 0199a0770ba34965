import collections
import math
import random

import numpy as np
import pytest
from helpers_llm import awkward, documents, some_texts, words

from tidecast.llm import base, lmscore, quality, rules, textstats


def stupid_backoff(texts, order, alpha):
    counts, per = [collections.Counter() for _ in range(order)], []
    for t in texts:
        w = words(t)
        own = [collections.Counter(tuple(w[i - k:i + 1]) for i in range(k, len(w))) for k in range(order)]
        per.append((w, own))
        for k in range(order):
            counts[k].update(own[k])
    total = sum(counts[0].values())
    for w, own in per:
        def s(g, own=own, n=total - len(w)):
            k = len(g) - 1
            c = counts[k][g] - own[k][g]
            if k == 0:
                return c / n if c else 1 / (n + 1)
            return c / (counts[k - 1][g[:-1]] - own[k - 1][g[:-1]]) if c else alpha * s(g[1:])
        yield len(w), sum(math.log10(s(tuple(w[max(0, i - order + 1):i + 1]))) for i in range(len(w)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(spark, order):
    texts = some_texts(order, 60) + ["", None, "one", "one two"]
    got = {r["doc_id"]: r for r in lmscore.score_documents(documents(spark, texts), order).collect()}
    for i, (n, want) in enumerate(stupid_backoff(texts, order, 0.4)):
        assert got[i]["n_words"] == n
        assert got[i]["log10_score"] == pytest.approx(want, abs=1e-9)
        assert (got[i]["mean_log10"] is None) == (n == 0)


def test_backoff_scores_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(base, "chunk_bytes", lambda n: 600)
    texts = some_texts(9, 60)
    got = {r["doc_id"]: r["log10_score"] for r in lmscore.score_documents(documents(spark, texts)).collect()}
    for i, (_, want) in enumerate(stupid_backoff(texts, 3, 0.4)):
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_backoff_of_awkward_rows(spark):
    docs = awkward(spark)
    assert lmscore.score_documents(docs).count() == docs.count()
    assert lmscore.score_documents(docs.limit(0)).count() == 0


def plain_statistics(t):
    t = t or ""
    w = words(t)
    c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines, dup = [x for x in t.split("\n") if words(x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return {"n_bytes": len(t.encode()), "n_chars": len(t), "n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": sum(x in "#*$%&|<>" for x in t), "n_lines": len(lines), "n_dup_lines": dup,
            "n_repeat_words": len(covered), "n_distinct": len(set(w)),
            "n_top_word": max(collections.Counter(w).values(), default=0),
            "n_upper": sum("A" <= x <= "Z" for x in t), "n_digits": sum("0" <= x <= "9" for x in t)}


def test_statistics(spark):
    docs = awkward(spark, some_texts(4, 80))
    want = collections.Counter(
        (r["doc_id"], *plain_statistics(r["text"]).values()) for r in docs.select("doc_id", "text").collect())
    names = list(plain_statistics(""))
    got = collections.Counter(
        (r["doc_id"], *(r[n] for n in names)) for r in textstats.text_statistics(docs).collect())
    assert got == want
    assert textstats.text_statistics(docs.limit(0)).count() == 0


def junk_and_prose(seed, n):
    rng = random.Random(seed)
    good, bad = [], []
    for _ in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        good.append(" ".join(w).capitalize() + ".")
        bad.append(" ".join(x.upper() + rng.choice(["!!", "###", "%%%"]) for x in w))
    return good, bad


def labelled_rows(spark, texts, quality_of):
    return spark.createDataFrame([(i, quality_of(i), 0) for i in range(len(texts))],
                                 "doc_id long, quality int, toxic int")


def test_forest_keeps_prose_and_finds_junk(spark):
    good, bad = junk_and_prose(1, 80)
    texts = good + bad
    docs, labels = documents(spark, texts), labelled_rows(spark, texts, lambda i: int(i < 80))
    statistics = textstats.text_statistics(docs)
    forest = rules.fit(statistics, labels, trees=50, rows=64, depth=8)
    scored = rules.score(statistics, forest)
    cut = rules.threshold(scored, labels, false_rate=0.02)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(scored, cut).collect()}
    assert sum(kept[i] for i in range(80)) >= 76
    assert sum(kept[i] for i in range(80, 160)) <= 4
    passed = {r["doc_id"] for r in rules.passing(docs, forest, cut).collect()}
    assert passed == {i for i, k in kept.items() if k}


def test_box_holds_every_row_of_a_table_larger_than_the_sample(spark, monkeypatch):
    good, bad = junk_and_prose(4, 60)
    texts = good + bad[:1]  # one unusual row, rarer than the sample could promise to hold
    statistics = textstats.text_statistics(documents(spark, texts))
    labels = labelled_rows(spark, texts, lambda i: int(i < 60))
    x = rules.features(statistics.toArrow())
    boxes, grow = [], rules.grow
    monkeypatch.setattr(rules, "grow", lambda sample, low, high, *a: boxes.append((low, high)) or grow(sample, low, high, *a))
    for max_rows in (5, 20, 1000):
        rules.fit(statistics, labels, max_rows=max_rows, trees=5, rows=16, depth=4)
    assert len(boxes) == 3
    for low, high in boxes:
        assert np.array_equal(low, x.min(axis=0)) and np.array_equal(high, x.max(axis=0))


def test_limits_without_labels_or_rows(spark):
    docs = awkward(spark, ["w" + " w" * 60, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))])
    statistics = textstats.text_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = rules.fit(statistics, none)
    scored = rules.score(statistics, forest)
    assert rules.threshold(scored, none) == 1.0
    got = {r["doc_id"]: r["base_failed"] for r in rules.judge(scored, 1.0).collect()}
    assert got[16] and not got[17] and got[18] and got[0]
    empty = statistics.limit(0)
    assert rules.fit(empty, none) is None
    assert rules.judge(rules.score(empty, None), 1.0).count() == 0
    odd = spark.createDataFrame([(17, None), (None, 1), (17, 7), (17, 1), (17, 0)], "doc_id long, quality int")
    assert {(r["doc_id"], r["label"]) for r in rules.known_labels(odd).collect()} == {(17, 0), (None, 1)}


def test_isolation_path_of_a_far_point_is_short():
    rng = np.random.default_rng(0)
    near, far = rng.normal(0, 0.1, (300, 3)), np.array([[5.0, 5.0, 5.0]])
    both = np.concatenate([near, far])
    forest = rules.grow(near, both.min(axis=0), both.max(axis=0), 100, 64, 8, 1)
    s = forest.scores(both)
    assert s[-1] > s[:-1].max()


def test_classifier_separates_held_out_rows(spark):
    good, bad = junk_and_prose(2, 150)
    texts = good + bad
    docs = documents(spark, texts)
    labels = labelled_rows(spark, texts, lambda i: int(i < 150))
    statistics = textstats.text_statistics(docs)
    model = quality.train(quality.labelled(statistics, labels.filter("doc_id % 3 > 0")), features=64)
    got = {r["doc_id"]: r["score"] for r in quality.score(statistics, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [i for i in got if i % 3 == 0]
    right = [(got[i] >= 0.7) == (i < 150) for i in held]
    assert np.mean(right) > 0.95


def test_classifier_without_rows(spark):
    docs = awkward(spark)
    statistics = textstats.text_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(quality.labelled(statistics, none)) is None
    assert {r["score"] for r in quality.score(statistics, None).collect()} == {0.5}
    assert quality.score(statistics.limit(0), None).count() == 0


def test_normal_equations_match_numpy(spark):
    rng = np.random.default_rng(5)
    good, bad = junk_and_prose(3, 60)
    texts = good + bad
    statistics = textstats.text_statistics(documents(spark, texts))
    labels = labelled_rows(spark, texts, lambda i: int(rng.random() < (0.8 if i < 60 else 0.2)))
    rows = quality.labelled(statistics, labels).cache()
    model = quality.train(rows, features=16, ridge=0.1)
    part = rows.selectExpr("*", "pmod(xxhash64('part', doc_id), 4) AS p").filter("p <> 0").toArrow()
    phi = model.kernel(textstats.ratios(part))
    y = part["label"].to_numpy().astype(float)
    penalty = 0.1 * len(y) / 16 * np.eye(17)
    penalty[-1, -1] = 0
    want = np.linalg.solve(phi.T @ phi + penalty + 1e-9 * np.eye(17), phi.T @ y)
    assert np.allclose(model.beta, want, rtol=1e-6, atol=1e-8)
    assert (np.diff(model.values) >= 0).all()


def test_pool_adjacent_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, w = rng.random(8), rng.random(8) + 0.1
        got = quality.pool_adjacent(v, w)
        assert (np.diff(got) >= -1e-12).all()
        # min-max formula of isotonic regression
        for i in range(8):
            want = max(min(np.average(v[a:b + 1], weights=w[a:b + 1]) for b in range(i, 8)) for a in range(i + 1))
            assert got[i] == pytest.approx(want)
