"""Operators that use DataFrame functions only: fingerprints and mixing."""

import collections
import hashlib
import re

import duckdb
import pytest
from helpers_llm import awkward, documents, some_texts

from tidecast.llm import mixing, syncmers
from tidecast.llm.catalog import ORACLE, QUERIES

NATIVE = ["op8_syncmers", "op10_mixing"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def i32(x):
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def murmur(words, h, length):
    """Spark's hash of 32-bit words."""
    for k in words:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= length
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def hash_text(t):
    b = t.encode()
    whole = len(b) // 4 * 4
    words = [int.from_bytes(b[i:i + 4], "little") for i in range(0, whole, 4)]
    words += [(x - 256 if x > 127 else x) & 0xFFFFFFFF for x in b[whole:]]
    return i32(murmur(words, 42, len(b)))


def hash_numbers(numbers):
    h = 42
    for n in numbers:
        h = murmur([n & 0xFFFFFFFF], h, 4)
    return i32(h)


def sketch(t, k=4, size=64):
    if not t:
        return []
    symbols = re.split("[\x20\x09-\x0d]+", t)
    if len(t) > syncmers.UNSPACED * len(symbols):
        symbols = list(t)
    h = [hash_text(s) for s in symbols]
    runs = [h[i:i + k] for i in range(len(h) - k + 1)]
    chosen = [hash_numbers(r) for r in runs if min(r[1:-1]) >= min(r[0], r[-1])]
    return sorted(set(chosen or h))[:size]


def likeness(a, b, size=64):
    if not a and not b:
        return 1.0
    least = sorted(set(a) | set(b))[:size]
    return len(set(a) & set(b) & set(least)) / max(len(least), 1)


def text_of(sketch_):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in sketch_)


def test_fingerprints_match_brute_force(spark):
    texts = some_texts(3, 80) + ["", None, "a", "a b", "a b c d", "日本語" * 60, "x" * 200, " ", "same text", "same text"]
    texts = texts * 3  # more rows than ranges
    docs = documents(spark, texts, 7, first=10)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    body = [t or "" for t in texts]
    for i, t in enumerate(body):
        following, r = body[(i + 1) % len(body)], got[10 + i]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == text_of(sketch(t))
        assert r["edited_fingerprint"] == text_of(sketch(edited))
        assert r["near_edited"] == pytest.approx(likeness(sketch(t), sketch(edited)))
        assert r["near_next"] == pytest.approx(likeness(sketch(t), sketch(following)))


def local_symbols(t):
    body = t.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    parts, end = re.split("[\x20\x09-\x0d]+", body), t[len(body):]
    out = [s for p in parts for s in (list(p) if len(p) > syncmers.UNSPACED else [p])]
    return out + ([] if not end else list(end) if len(parts[-1]) > syncmers.UNSPACED else [""])


def all_anchors(t, k=4):
    """Hash and place of every closed syncmer."""
    h = [hash_text(s) for s in local_symbols(t)] if t else []
    runs = [(h[i:i + k], i) for i in range(len(h) - k + 1)]
    chosen = [(hash_numbers(r), i) for r, i in runs if min(r[1:-1]) >= min(r[0], r[-1])]
    return sorted(chosen or [(x, i) for i, x in enumerate(h)])


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_all_anchors_match_brute_force(spark):
    long_texts = [" ".join(some_texts(i, 12)) for i in (21, 22)]
    texts = some_texts(5, 20) + long_texts + [
        "", None, "a", "a b c d", "日本語" * 60, "x" * 200, " ", "one " + "y" * 25 + "  two\n", "\n" + "z" * 24 + " \n",
        "\U0001f600" * 25 + " \t", "\U0001f600" * 24 + " "]
    docs = documents(spark, texts, 5)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs, size=None).collect()}
    body = [t or "" for t in texts]
    assert max(len(set(all_anchors(t))) for t in body) > 500
    for i, t in enumerate(body):
        following, r = body[(i + 1) % len(body)], got[i]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        for name, places, of in (("fingerprint", "anchors", t), ("edited_fingerprint", "edited_anchors", edited)):
            want = all_anchors(of)
            assert [(x >> 32, x & 0xFFFFFFFF) for x in r[places]] == want
            assert r[name] == text_of(sorted({h for h, _ in want}))
        assert r["near_edited"] == pytest.approx(jaccard(all_anchors(t), all_anchors(edited)))
        assert r["near_next"] == pytest.approx(jaccard(all_anchors(t), all_anchors(following)))


def test_query_finds_a_passage_shared_by_long_documents(spark, tmp_path):
    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    passage = text("shared", 40)
    texts = [f"{text('a', 3000)} {passage} {text('b', 3000)}", f"{text('c', 3000)} {passage} {text('d', 3000)}"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op8_syncmers"](spark, str(tmp_path)).collect()
    common = set.intersection(*({x >> 32 for x in r["anchors"]} for r in rows))
    assert len(common) >= 10 and all(r["near_next"] > 0 for r in rows)


def test_symbols_do_not_depend_on_the_rest_of_the_text(spark):
    chinese = "\n".join("".join(chr(0x4E00 + (i * 7919 + j * 104729) % 20000) for j in range(249)) for i in range(4))
    english = " ".join(f"word{i}" for i in range(200))
    got = {r["doc_id"]: r["near_edited"] for r in syncmers.fingerprints(
        documents(spark, [chinese, english]), size=None).collect()}
    assert got[0] > 0.6
    got = {r["doc_id"]: r["near_edited"] for r in syncmers.fingerprints(documents(spark, [chinese, english])).collect()}
    assert got[0] > 0.5


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark, some_texts(1, 10))
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    one = syncmers.fingerprints(documents(spark, ["only one text here today"])).first()
    assert one["near_next"] == 1.0


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE["op10_mixing"])
    got = QUERIES["op10_mixing"](spark, "/root/testdata/sf0.01")
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(
        map(tuple, want.select(*names).fetchall()), key=str)


def test_raking_meets_the_marginals(spark):
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 2}", 10 * (i % 7) + 1) for i in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    cells = cells.groupBy("source", "lang", "topic").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    plan = mixing.Plan(temper=(("source", 0.5), ("lang", 0.3), ("topic", 0.0)), rounds=30)
    raked = mixing.rake(cells, plan).collect()
    for name, power in plan.temper:
        tokens, weight = collections.Counter(), collections.Counter()
        for r in raked:
            tokens[r[name]] += r["tokens"]
            weight[r[name]] += r["weight"]
        total = sum(v**power for v in tokens.values())
        for k, v in tokens.items():
            assert weight[k] == pytest.approx(v**power / total, rel=1e-6)


def test_probabilities_spend_the_share(spark):
    rows = [("a", 1000, 0.1), ("b", 100, 0.5), ("c", 10, 0.4)]
    cells = spark.createDataFrame(rows, "source string, tokens long, weight double")
    got = {r["source"]: r["probability"] for r in mixing.probabilities(cells, mixing.Plan(share=0.5)).collect()}
    assert got["b"] == got["c"] == 1.0
    assert 1000 * got["a"] + 110 == pytest.approx(555)
    full = mixing.probabilities(cells, mixing.Plan(share=1.0)).collect()
    assert all(r["probability"] == pytest.approx(1.0) for r in full)


def test_a_mixture_without_a_share_meets_its_targets(spark):
    texts = [f"{'mail a@b.org ' if i % 10 == 0 else ''}" + "word " * (20 + i % 7) for i in range(240)]
    docs = documents(spark, texts)
    given = (("source", (("s1", 1.0), ("s2", 2.0), ("absent", 5.0))),)
    for plan in (mixing.Plan(share=None, rounds=30), mixing.Plan(share=None, rounds=30, targets=given)):
        mixed = mixing.mix(docs, plan)
        report = {(r["dimension"], r["name"]): r for r in mixing.achieved(mixed, plan).collect()}
        assert report["topic", "contact"]["target"] > report["topic", "contact"]["natural"]
        for r in report.values():
            assert r["expected"] == pytest.approx(r["target"], abs=1e-6)
            assert 0 <= r["kept"] <= 1
        assert mixed.agg({"probability": "max"}).first()[0] == pytest.approx(1.0)
    assert report["source", "s2"]["target"] == pytest.approx(2 / 3)
    assert report["source", mixing.NONE]["target"] == report["source", mixing.NONE]["kept"] == 0
    missed = {(r["dimension"], r["name"]): r for r in mixing.achieved(mixing.mix(docs)).collect()}
    r = missed["topic", "contact"]
    assert r["natural"] < r["expected"] < r["target"] - 1e-3  # the share of 0.9 is too large for it


def test_topics_in_order_of_the_rules(spark):
    texts = ["Licensed under", "mail me@x.org", "a | b", "plain", "licence @ | ", None, ""]
    rows = mixing.with_cell(documents(spark, texts), mixing.Plan()).collect()
    got = {r["doc_id"]: r["_topic"] for r in rows}
    assert [got[i] for i in range(7)] == ["legal", "contact", "tables", "prose", "contact", "prose", "prose"]


def test_mixing_of_awkward_rows(spark):
    docs = awkward(spark, some_texts(2, 40))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all((r["n_tokens"] > 0) or not r["kept"] for r in rows)
    assert {r["source"] for r in rows} == {"s1", "s2", mixing.NONE}
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
