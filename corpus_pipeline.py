"""The corpus pipeline: quality rules, language, near-duplicates, personal data, packing.

Each stage works on all that the one before kept. The first four return the
columns of documents: rejected documents go, ``lang`` becomes the language
found, one document of each near-duplicate group stays, personal data is
replaced by its kind in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rockframe.llm import langid, packing, pii, quality, simhash
from rockframe.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("language", language), ("near-dedup", near_dedup), ("personal data", personal_data), ("packing", pack)]

#: Fitted models and a compiled tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
