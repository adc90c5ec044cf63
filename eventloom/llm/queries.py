"""The operators of this package as named queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bloom_lm, cover_tree, divergence, kn_classifier, licenses, mixing, packing, quality_rules, secrets, sentencepiece_nbest,
    simhash, token_scan, whitening,
)
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kn_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("k1", "k2")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=3)


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return bloom_lm.score(table(spark, sf_dir, "documents"), held_out, min_count=1)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    blocks, order = token_scan.flat_table(docs, tokenizer_path("byte_bpe_50k.json"))
    return token_scan.scan(blocks).join(order, ["file", "doc_no"], "left").select(
        "doc_id", "file", "doc_no", "start", "n_tokens", "closed"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_classifier, op3_packing, op4_secret_scan, op5_sentencepiece,
        op6_bloom_lm, op7_token_counts, op8_license_scan, op9_simhash, op10_cover_tree, op11_divergence, op12_whitening,
        op13_mixing,
    )
}
