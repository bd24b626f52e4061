"""Corpus pipeline: each stage reads its predecessor's documents and writes its own as Parquet.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajens.llm.common import store, table
from trajens.llm.langid import accepted, train
from trajens.llm.mixing import mixed_documents
from trajens.llm.packing import pack
from trajens.llm.pii import configured_key, pseudonymize
from trajens.llm.simhash import keep_one_per_group


#: rows of an Arrow batch between the JVM and a Python worker: documents may be long, and both hold a batch
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language codes: documents whose language can't be told go."""
    small_batches(spark)
    return accepted(docs, train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each component stays, the one with the smallest id."""
    small_batches(spark)
    return keep_one_per_group(docs, shingle=3, radius=2)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data; n_chars follows the new text."""
    small_batches(spark)
    return with_length(pseudonymize(docs, configured_key(spark), counted=False))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: each document as often as it is taken."""
    small_batches(spark)
    return with_length(mixed_documents(docs))


def with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Concatenate and cut into sequences of 2048 token ids."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: no SQL can express the trained, hashed and tokenized stages; tests hold the rows against brute force
ORACLE_SQL = None
