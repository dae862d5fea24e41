"""A training corpus from raw documents: five stages, each an operator of ``cohortlake.llm``, each written and read again.

Nulls and edges: rows with a null text have no words; they pass the first four stages if the classifier keeps them, and
pack as an empty document. Rows with a null id are never taken for copies. An empty table gives no rows. ``n_chars``
follows the text that a stage leaves.

A stage is given what its predecessor returned as a written table, and removes the intermediate tables that stages before it
wrote; tables of anybody else stay, and so do those of the last stage, whose result is read later.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import decontamination, near_dedup, packing, quality, substring
from cohortlake.llm.common import crc_remainder, fresh_path, owned, release, table
from cohortlake.llm.encoding import default_tokenizer


OWNER = "corpus_pipeline"


def _owned(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage's intermediate tables belong to the pipeline; those of the stages before go."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER, docs)
        with owned(spark, OWNER):
            return stage(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_owned
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)


@_owned
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


@_owned
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them."""
    return _measured(substring.cut_repeats(docs))


@_owned
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that are mostly benchmark go altogether."""
    return _measured(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    release(spark, OWNER, docs)
    return packing.pack(docs, default_tokenizer(), keep_encoder=False)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]

#: no SQL form: the classifier is trained, and sketches and tokens have none; tests check each stage by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
