"""The Merkle manifest against a plain tree, built from sorted rows."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pyspark.sql.functions as F
import pytest
from helpers_llm import awkward, collected, documents, some_texts

from tidecast.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, **other):
    values = [{**row, **other}[f] for f in FIELDS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def runs(nodes):
    return [nodes[i:i + 8] for i in range(0, len(nodes), 8)]


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*r) for r in runs(out[-1])])
    return out


def way(at, tree):
    out = []
    for nodes in tree[:-1]:
        out.append((at % 8, runs(nodes)[at // 8]))
        at //= 8
    return out


def expected(rows):
    rows = [{**r, "leaf": leaf(r)} for r in rows]
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["leaf"])):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r["leaf"] for r in groups[g]]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = way(i, trees[g]) + way(at, crown)
            third = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            digest = leaf(r, text=text) if third else r["leaf"]
            for slot, run in steps:
                digest = h(*run[:slot], digest, *run[slot + 1:])
            root = crown[-1][0]
            proof = h(*(d for slot, run in steps for d in run[:slot] + run[slot + 1:]))
            out.append((r["doc_id"], r["leaf"], trees[g][-1][0], root, proof, digest, digest == root))
    return sorted(out, key=repr)


def got(docs):
    return sorted(collected(manifest.manifest(docs, tampered=manifest.tampered_third(),
                                              tampering={"text": manifest.lowered()})), key=repr)


def rows(docs):
    return [r.asDict() for r in docs.select(*FIELDS).collect()]


def test_awkward_rows(spark):
    docs = awkward(spark, some_texts(seed=2, n=60))
    assert got(docs) == expected(rows(docs))


def test_several_blocks_groups_and_wide_keys(spark):
    rng = random.Random(4)
    keys = [rng.randint(-(1 << 62), 1 << 62) for _ in range(300)] + list(range(9000)) + [-(1 << 63), (1 << 63) - 1, -1]
    data = [(k, f"T {k}", rng.choice(["en"] * 80 + [None, "", "-", "de", "é", *"abcdefgh"]), None, 3) for k in keys]
    rng.shuffle(data)
    docs = spark.createDataFrame(data, documents(spark, []).schema)
    found, wanted = got(docs), expected(rows(docs))
    assert found == wanted
    assert {r[6] for r in found} == {True, False}


def test_a_third_of_all_rows_under_one_key_or_none(spark):
    data = [(7, f"Text {i % 900}", "en", "s", i % 5) for i in range(1500)]
    data += [(None, f"Text {i}", "en", None, None) for i in range(1500)] + [(i, "X", "en", "s", 1) for i in range(1500)]
    docs = spark.createDataFrame(data, documents(spark, []).schema).repartition(5)
    assert got(docs) == expected(rows(docs))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_small_trees(spark, n):
    docs = documents(spark, ["One Text"] * n)
    assert got(docs) == expected(rows(docs))


@pytest.mark.parametrize("n", [3, 700])
def test_ranks_of_containers(n):
    rng = np.random.default_rng(1)
    numbers = np.sort(rng.integers(0, manifest.SPAN, n))
    low, count = np.unique(numbers, return_counts=True)
    bits, more = manifest.pack(low, count)
    back = manifest.unpack(bits, more)
    assert back[0].tolist() == low.tolist() and back[1].tolist() == count.tolist()
    flags = np.zeros(manifest.SPAN, bool)
    flags[low] = True
    directory = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))[:-1]]).astype(np.uint16).tobytes()
    assert manifest.rank(low, bits, more, directory).tolist() == [int((numbers < x).sum()) for x in low]


@pytest.mark.parametrize("n", [*range(254, 259), manifest.SPAN - 1, manifest.SPAN])
def test_a_container_is_read_as_it_was_written(n):
    """256 numbers take as many bytes in a list as in a bitmap."""
    low = np.sort(np.random.default_rng(n).choice(manifest.SPAN, n, replace=False))
    for count in (np.ones(n, np.int64), 1 + low % 3):
        bits, more = manifest.pack(low, count)
        back = manifest.unpack(bits, more)
        assert back[0].tolist() == low.tolist() and back[1].tolist() == count.tolist()
        flags = np.zeros(manifest.SPAN, bool)
        flags[low] = True
        directory = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))[:-1]]).astype(np.uint16).tobytes()
        assert manifest.rank(low, bits, more, directory).tolist() == (np.cumsum(count) - count).tolist()


@pytest.mark.parametrize("partitions", [1, 5])
def test_as_many_keys_as_make_a_list_as_long_as_a_bitmap(spark, partitions):
    rng = random.Random(partitions)
    some = lambda first, n: [first + k for k in rng.sample(range(manifest.SPAN), n)]
    data = [(k, f"T {k}", "en", "s", 1) for k in some(0, 256) + some(manifest.SPAN, 300) + some(5 * manifest.SPAN, 256)]
    twice = some(0, 256)
    data += [(k, f"U {k}", "de", "s", 1) for k in twice + twice[:9]] + [(k, "V", None, None, None) for k in some(-manifest.SPAN, 256)]
    rng.shuffle(data)
    docs = spark.createDataFrame(data, documents(spark, []).schema).repartition(partitions)
    assert got(docs) == expected(rows(docs))


def test_any_changed_field_fails_and_others_do_not_matter(spark):
    docs = documents(spark, some_texts(seed=5, n=40)).withColumn("extra", F.rand())
    some = F.col("doc_id") % 4 == 1
    out = manifest.manifest(docs, tampered=some, tampering={"source": F.lit("another")}).select(
        "verified", (F.col("doc_id") % 4 == 1).alias("t")).collect()
    assert all(r.verified != r.t for r in out)
