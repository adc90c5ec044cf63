"""From raw documents to packed sequences: five stages, each a table that the next one reads.

Null, empty and blank texts have fewer than ten words, so the first stage rejects them, null ids or
not. Of repeated rows, as of near copies, one stays after the third stage. Texts are taken whole,
however long. Null languages and sources are values like any other. Extra columns stay up to the last
stage, whatever their names; packing returns its own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import kn_classifier, packing, quality_rules, secrets, simhash
from eventloom.llm.common import table, written
from eventloom.llm.queries import QUERIES as OPERATORS
from eventloom.llm.queries import tokenizer_path


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned rules."""
    return quality_rules.keep(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def reject_by_perplexity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return kn_classifier.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs, shingle=3, bits=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced by a mark and ``n_chars`` brought up to date."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", reject_by_rules),
    ("quality classifier", reject_by_perplexity),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

# Learned rules, a learned model, 64-bit hash votes and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {**OPERATORS, "pipeline": run}
