import random

import numpy as np
import pytest
from helpers_llm import awkward, documents, words

from tidecast.llm import minhash


def shingles(t, size):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, threshold=80):
    sets = [(k, shingles(t, size)) for k, t in rows if k is not None]
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= threshold * (len(x) + len(y) - both):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return {k: find(k) for k in parent}


def near_copies(seed, groups):
    rng = random.Random(seed)
    vocab, out = [f"w{i}" for i in range(400)], []
    for _ in range(groups):
        t = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        out.append(" ".join(t))
        for _ in range(rng.randint(0, 10)):
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(len(u))] = rng.choice(vocab)
            out.append(" ".join(u))
            if rng.random() < 0.3:
                t = u  # chains whose ends are not alike
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_components_match_brute_force(spark, size):
    texts = near_copies(size, 40) + ["", None, "A b", "a B\n", "a b c", "x"]
    docs = documents(spark, texts, 5)
    want = components(list(enumerate(texts)), size)
    for r in minhash.near_duplicates(docs, words_per_shingle=size).collect():
        k = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(shingles(texts[k], size)), want[k], want[k] == k)


def test_group_with_several_components(spark):
    """Members of a band that the pairing with the least one leaves apart are compared block by block."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    core = [rng.choice(vocab) for _ in range(60)]
    texts = [" ".join(core + [rng.choice(vocab) for _ in range(22)]) for _ in range(12)]
    for t in list(texts):
        w = t.split(" ")
        w[-1] = "changed"
        texts.append(" ".join(w))
    docs = documents(spark, texts, 3)
    want = components(list(enumerate(texts)), 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words_per_shingle=4).collect()}
    assert got == want and len(set(want.values())) > 1


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = minhash.near_duplicates(docs, words_per_shingle=4).collect()
    assert len(rows) == docs.count()
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


@pytest.mark.parametrize("rows", [
    [(1, A), (5, A), (5, B)],
    [(1, A), (5, A), (5, B), (9, B)],
    [(5, B), (5, A), (1, A), (9, B), (9, C), (11, C), (12, A + " more"), (3, ""), (3, None), (5, ""), (14, ""), (14, "x y")],
    [(7, A)] * 60 + [(7, B)] * 3 + [(8, B), (6, C), (9, A)] + [(i, C) for i in range(20, 40)],
])
def test_repeated_keys_link_all_their_texts(spark, rows):
    want = components(rows, 4)
    got = minhash.near_duplicates(rows_of(spark, rows), words_per_shingle=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted(
        (k, want[k], want[k] == k) for k, _ in rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_keys_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = near_copies(seed, 14) + ["", "a b"]
    rows = [(rng.randrange(40), rng.choice(texts)) for _ in range(90)]
    want = components(rows, 5)
    got = minhash.near_duplicates(rows_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((k, want[k]) for k, _ in rows)


def test_rows_go_only_for_texts_that_stay(spark):
    rows = [(1, A), (5, A), (5, B), (9, B), (9, C), (12, A + " more"), (3, ""), (3, None), (None, A), (None, A), (4, C), (4, C)]
    got = minhash.deduplicated(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, A), (5, B), (4, C), (3, ""), (3, None), (None, A), (None, A)], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_rows_that_stay_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = near_copies(seed, 12)
    rows = sorted({(rng.randrange(30), rng.choice(texts)) for _ in range(80)})
    want = components([(i, t) for i, (_, t) in enumerate(rows)], 5)
    got = [tuple(r) for r in minhash.deduplicated(rows_of(spark, rows)).collect()]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(want[i], []).append(r)
    assert len(got) == len(groups) and set(got) <= set(rows)
    assert sorted(k for k, _ in got) == sorted(min(k for k, _ in g) for g in groups.values())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (9, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in minhash.components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}
    assert minhash.components(links.limit(0)).count() == 0


def test_salted_pairs_meet_the_same_rows(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(2, 3)], "a long, b long")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(1, 40)], "doc_id long, text string")
    dealt, salts = minhash.dealt(pairs, each=4)
    assert {r["a"]: r["salts"] for r in salts.collect()} == {1: 10, 2: 1}
    assert dealt.select("salt").distinct().count() > 3
    got = {(r["a"], r["b"], r["value_a"], r["value_b"]) for r in minhash.with_both(pairs, rows, "text").collect()}
    assert got == {(r["a"], r["b"], f"t{r['a']}", f"t{r['b']}") for r in pairs.collect()}


def test_sequential_comparison_prunes_at_the_chosen_miss_rate():
    least = minhash.prune_table(16, 112, 0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * 112
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 30, (4000, 112), dtype=np.uint32)
    alike = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    apart = np.where(rng.random(a.shape) < 0.3, a, a + np.uint32(1))
    assert len(minhash.survivors(a, alike, least, 16)) == 4000
    assert len(minhash.survivors(a, apart, least, 16)) < 40


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, one, two = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    keys = [np.unique(np.concatenate([common, x])) for x in (one, two)]
    doc = np.repeat([0, 1], [len(k) for k in keys])
    sig = minhash.signatures(doc, np.concatenate(keys), 3, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.04
    assert (sig[2] == 0xFFFFFFFF).all()
