import hashlib
import struct

import public_tokenizers
import pytest
from helpers_llm import awkward, documents, some_texts, words
from test_near_duplicates import components
from test_substrings import removed_by_earlier
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidecast.llm import mixing
from tidecast.llm.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_registered_names():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "substring_dedup", "source_mixing", "tokenize"]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rules = stages["quality_rules"](spark, docs, FOLDER)
    assert rules.columns == names
    before = [r for r in rules.collect()]
    assert 0 < len(before) < docs.count()
    assert all(len(words(r["text"])) >= 50 for r in before)

    near = stages["near_dedup"](spark, rules, FOLDER)
    label = components([(r["doc_id"], r["text"]) for r in before], 5)
    kept = [r for r in before if label[r["doc_id"]] == r["doc_id"]]
    assert sorted(near.collect()) == sorted(kept) and near.columns == names

    sub = stages["substring_dedup"](spark, near, FOLDER)
    want = {}
    for k, _, _, _, rest in removed_by_earlier([(r["doc_id"], r["text"].encode()) for r in kept], 50):
        text = rest.decode("utf-8", "ignore")
        if words(text):
            want[k] = (text, len(text))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in sub.collect()} == want and sub.columns == names

    mixed = stages["source_mixing"](spark, sub, FOLDER)
    chosen = {r["doc_id"] for r in mixing.mix(sub).collect() if r["kept"]}
    assert {r["doc_id"] for r in mixed.collect()} == chosen and mixed.columns == names

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["tokenize"](spark, mixed, FOLDER).collect():
        ids = library.encode(want[r["doc_id"]][0], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]][0].encode()).hexdigest()


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(docs.collect())


@pytest.mark.parametrize("texts", [[], ["", None, " "], some_texts(4, 30)])
def test_stages_without_much_to_do(spark, texts):
    docs = documents(spark, texts) if texts else documents(spark, ["x"]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "tokenize":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs.collect()


def test_stages_keep_columns_with_clashing_names(spark):
    docs = awkward(spark, [f"word{i} " + " ".join(f"w{i}x{k}" for k in range(80)) for i in range(30)])
    names, seen = docs.columns, {str(r[5:]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names, name
        rows = docs.collect()
        assert rows and {str(r[5:]) for r in rows} == seen


#: Queries whose result is not one row per document.
OTHERS = {"op12_topk", "op13_collocations"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHERS))
def test_every_query_returns_a_row_per_document(spark, name):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = QUERIES[name](spark, FOLDER)
    assert rows.count() == n and rows.select("doc_id").distinct().count() == n
