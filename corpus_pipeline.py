"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Every stage but the last returns the columns of ``documents``; each result is
written once as Parquet and read again as the next stage's documents.  The
stages work row by row where a row's fate is its own, and by a text's hash or
a document's id where it is not, so null ids, repeated rows and columns of any
name pass through (see each operator for its defined results).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from vitrine.llm.common import saved
from vitrine.session import bounded_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: rejected documents go, kept ones lose their failing lines."""
    return quality.clean(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays, once."""
    return jaccard_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span found is replaced by a mark; all documents stay."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cost-balanced packing: one row per piece of a training sequence, with its ids' checksum."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _bounded(stage):
    """The stage with small batches between Spark and its Python workers, also where it runs by itself."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


STAGES = [
    ("quality_rules", _bounded(quality_stage)),
    ("ngram_jaccard_join", _bounded(jaccard_stage)),
    ("benchmark_decontamination", _bounded(benchmark_stage)),
    ("secret_scans", _bounded(secret_stage)),
    ("packing", _bounded(packing_stage)),
]

# The learnt formats and the tokenizer have no SQL form; tests/llm/test_pipeline.py
# holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
