"""Queries of this subpackage and their SQL: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import (
    base, bpe, chunking, collocations, langid, lmscore, manifest, minhash, mixing, quality, rules, suffixes, syncmers,
    textstats, topk,
)
from tidecast.staging import stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.read(spark, folder, "documents")
    model = langid.train(docs.filter(~base.held_out()), langid.vocabulary(PIECES))
    return langid.identify(docs, model).select(
        "doc_id", base.held_out().alias("held_out"), "lang_pred", "score")


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.score_documents(base.read(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = base.read(spark, folder, "documents"), base.read(spark, folder, "labels")
    statistics = stage(textstats.text_statistics(docs), "statistics")
    model = quality.train(quality.labelled(statistics, labels.filter(~base.held_out())))
    score = F.col("score")
    return quality.score(statistics, model).select(
        "doc_id", base.held_out().alias("held_out"), "score", (score >= 0.7).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = base.read(spark, folder, "documents"), base.read(spark, folder, "labels")
    scored, _, cut = calibrated(docs, labels)
    return rules.judge(scored, cut).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "anomaly")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(base.read(spark, folder, "documents")).withColumn(
        "probability", F.round("probability", 6))


def calibrated(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, rules.Forest | None, float]:
    """Scored statistics of the documents, the forest and its cut-off; held-out labels stay unread."""
    statistics = stage(textstats.text_statistics(docs), "statistics")
    labels = labels.filter(~base.held_out())
    forest = rules.fit(statistics, labels)
    scored = stage(rules.score(statistics, forest), "anomalies")
    return scored, forest, rules.threshold(scored, labels)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedup_substrings(base.read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(base.read(spark, folder, "documents"), words_per_shingle=4)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = bpe.encode(base.read(spark, folder, "documents"), bpe.load(BYTE_BPE), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(base.read(spark, folder, "documents"), size=None)


def op9_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.dedup_chunks(base.read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(base.read(spark, folder, "documents"), tampered=manifest.tampered_third(),
                             tampering={"text": manifest.lowered()})


def op12_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(base.read(spark, folder, "embeddings"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(base.read(spark, folder, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_quality": op3_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_minhash": op6_minhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_syncmers": op8_syncmers,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_mixing": op10_mixing,
    "op11_manifest": op11_manifest,
    "op12_topk": op12_topk,
    "op13_collocations": op13_collocations,
}
ORACLE: dict[str, str] = {
    "op10_mixing": mixing.oracle(),
    "op11_manifest": manifest.oracle(),
    "op12_topk": topk.oracle(),
    "op13_collocations": collocations.oracle(),
}
