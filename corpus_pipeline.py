"""Corpus pipeline: documents pass five stages; each is one operator of ``logloom.llm``.

Every stage takes all rows its predecessor kept and returns the columns of
documents, but the last, which adds the tokens.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.common import table
from logloom.llm.decontaminate import decontaminate
from logloom.llm.quality import keep_good
from logloom.llm.secrets import without_secrets
from logloom.llm.sentencepiece_codec import encode
from logloom.llm.simhash import keep_one
from logloom.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a rule finds a secret go."""
    return without_secrets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens, verified against the reference library and decoded again."""
    return encode(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("sentencepiece", token_stage),
]

ORACLE_SQL = None  # a trained model, iterated components and a tokenizer: tested stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written as Parquet in the shared folder and read again by the next."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
