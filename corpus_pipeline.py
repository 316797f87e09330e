"""The training-data pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import learnable, table, unused
from inkprint.llm.decontamination import without_benchmark
from inkprint.llm.mixing import mixed, written_place
from inkprint.llm.near_duplicates import without_near_duplicates
from inkprint.llm.quality_model import ACCEPT, fit_quality, quality_score
from inkprint.llm.sharding import document_dimensions, kd_shards
from inkprint.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of text that a shard should reach: the number of shards grows with the input.
TARGET_BYTES = 1 << 30
#: There are so many shards of a small input, too, for as many readers.
SHARDS = 8


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score the classifier accepts; it learns from labels among ``docs``."""
    labels = table(spark, sf_dir, "labels").filter(learnable(F.col("doc_id")))
    score = unused(docs, "_score")
    scored = docs.withColumn(score, quality_score(fit_quality(docs, labels), F.col("text")))
    return scored.filter(F.col(score) >= ACCEPT).drop(score)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out so that sources follow their target weights."""
    return mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document, and its place there in the order that ``docs`` was written in."""
    return kd_shards(
        docs, document_dimensions(docs), shards=SHARDS, target_bytes=TARGET_BYTES, place=written_place(docs)
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", accepted),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

#: A classifier and alignments are not for SQL; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
