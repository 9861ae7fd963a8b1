"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import mixing, phrases, quality, sharding, substring
from .alignment import align_tokens
from .decontam import decontaminate
from .html import extract_text
from .lines import line_dedup
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .phrases import mine_phrases
from .quality import quality_rules
from .scoring import score_words
from .sharding import shard
from .substring import substring_dedup
from .urls import filter_urls


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The rules of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return score_words(table(spark, sf_dir, "documents"), good)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal repeated run counts, also one of a single line."""
    out = line_dedup(table(spark, sf_dir, "documents"), min_lines=1)
    return out.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies; they are installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_substring": op2_substring,
    "op3_urls": op3_urls,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_lines": op9_lines,
    "op10_sharding": op10_sharding,
    "op11_phrases": op11_phrases,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}
SQL: dict[str, str] = {"op2_substring": substring.SQL, "op5_quality": quality.SQL, "op7_mixing": mixing.SQL, "op10_sharding": sharding.SQL, "op11_phrases": phrases.SQL}
