"""The training-data pipeline: five stages over ``documents``, each an operator of ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import packing, quality, repeats, secrets, simhash
from llm.common import Scratch
from llm.queries import BPE_FILE


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    return quality.keep_target(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one_per_group(docs, words=4, distance=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of 20 words or more that start earlier elsewhere."""
    return repeats.clean_documents(docs, window=20)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, BPE_FILE, capacity=2048, end_id=1)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_per_group),
    ("repeated_spans", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The tokenizer and the hash models are not to be had in SQL; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
