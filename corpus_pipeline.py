"""The corpus pipeline: documents in, token blocks out. Each stage reads what its predecessor wrote as Parquet."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import decontam, mixing, quality, simhash, tokens
from gradeframe.llm.graph import staged
from gradeframe.session import tune


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.quality_filter(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.simhash_dedup(docs, simhash.NEAR_COPY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item of ``benchmark``."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of each document's ids as read back from the written token blocks."""
    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _tuned(stage):
    """The stage under the session defaults, also when it is called apart from ``run``."""
    return lambda spark, docs, sf_dir: stage(tune(spark), docs, sf_dir)


STAGES = [(name, _tuned(stage)) for name, stage in (
    ("quality rules", quality_stage), ("simhash near-dedup", dedup_stage), ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage), ("token output", token_stage))]

#: SQL states neither the rolling-hash rules nor the graph closure, the Newton steps or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
