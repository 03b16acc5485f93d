"""A training-data pipeline over ``documents``: each stage reads what the one
before it wrote.

Language ID drops documents in no learned language, near-dedup keeps one document
of each group, decontamination drops documents with benchmark passages, secrets
are redacted, and the rest is packed into sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lithos.lineage import shared_folder
from lithos.llm import decontaminate, langid, neardup, packing, secrets
from lithos.sources import storage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_only(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("secret_scan", redacted),
    ("pack", packed),
]

#: SQL can't express the prototypes of language ID or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared checkpoint folder and read again.
    A stage's files go once the next one is written; the folder goes at the end,
    because packing has its own copy of what it read before it returns."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            storage.delete(spark, f"{folder}/{last}")
        last = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    storage.delete(spark, folder)
    return out
