"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the documents of the next.

All stages but the last keep the columns of documents. Language ID drops texts without a language (null, or no letter);
the near-duplicate stage keeps the document with the smallest id of each class; decontamination drops documents in which a
benchmark window occurs; mixing repeats or leaves out documents so that each source comes near its target; packing returns token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import shared_dir, table
from plinth.llm.decontam import decontaminate
from plinth.llm.langid import keep_identified
from plinth.llm.mix import mixed
from plinth.llm.neardup import drop_near_duplicates
from plinth.llm.pack import pack_tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_tokens(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: No SQL: language models, near-duplicate groups, Newton steps and tokenizers; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
