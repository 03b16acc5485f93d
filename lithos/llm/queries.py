"""Registered queries of this subpackage and their SQL, where SQL can express
them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithos.llm import chat, decontaminate, fingerprint, html_text, langid, neardup, packing, quality, reshard, secrets


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_read(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.report(_read(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neardup": op2_neardup,
    "op3_langid": op3_langid,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_fingerprint": op6_fingerprint,
    "op7_chat": op7_chat,
    "op8_secrets": op8_secrets,
    "op9_reshard": op9_reshard,
    "op10_pack": op10_pack,
}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op2_neardup": neardup.ORACLE, "op5_quality": quality.ORACLE, "op7_chat": chat.ORACLE}
