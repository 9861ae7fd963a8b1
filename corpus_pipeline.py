"""The corpus pipeline: documents through quality rules, near-duplicate removal, benchmark
decontamination, mixing and sharding.

Every stage takes all documents its predecessor kept, decides by doc_id and returns the
documents that stay, with all their columns; the last one returns the shard of each document.
Documents without an id are decided together, as one id: they stay if any of them would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, table
from spanforge.llm.decontam import decontaminate
from spanforge.llm.minhash import near_duplicates
from spanforge.llm.mixing import mix_sources
from spanforge.llm.quality import quality_rules
from spanforge.llm.sharding import shard


def _only(docs: DataFrame, verdict: DataFrame, condition: str) -> DataFrame:
    """The rows of docs whose id has a verdict row that meets the condition."""
    ids = verdict.where(condition).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return docs.alias("docs").join(ids.alias("ids"), F.col("docs.doc_id").eqNullSafe(F.col("ids.doc_id")), "left_semi").select("docs.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds; null and empty texts go,
    null languages and sources form groups of their own, repeated rows stay or go together."""
    return _only(docs, quality_rules(docs), "kept")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id; documents without an id or without words
    belong to no group and stay, as do repeated rows of one that stays."""
    return _only(docs, near_duplicates(docs), "kept")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts and an empty benchmark
    contaminate nothing, an id with several texts goes if one of them is contaminated."""
    return _only(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")), "not contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose words have the target shares; repeated rows are taken or left together,
    documents of cells without words stay. A column named topic plays no part here."""
    return _only(docs, mix_sources(docs), "sampled")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, shard, depth) of every row, repeated ones and those without an id or text too."""
    return shard(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Alignment and graph components have no plain SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
