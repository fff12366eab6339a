"""From raw documents to tokens: quality rules, near-duplicates, decontamination, secrets, encoding.

Every stage takes `(spark, docs, sf_dir)`; `run` writes each result as Parquet in
the shared folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.llm import decontamination, quality, secrets, simhash, tokens
from groundswell.llm.pieces import Vocabulary
from groundswell.llm.queries import tokenizer_path
from groundswell.plans.shared import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject, by their own text or by their host, go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: four-word shingles, four bits at most."""
    return simhash.one_per_group(docs, shingle=simhash.SHINGLE, budget=simhash.BUDGET)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that repeat benchmark windows in at least one of twenty words."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and `n_chars` follows the text; every document stays."""
    before = docs.withColumn("n_chars", F.col("n_chars") - F.coalesce(F.length("text"), F.lit(0)))
    return secrets.redacted(before).withColumn("n_chars", F.col("n_chars") + F.coalesce(F.length("text"), F.lit(0)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    coded = tokens.encode(docs, Vocabulary.load(tokenizer_path()), keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", without_secrets),
    ("sentencepiece_encoding", encode),
]

# XXH64 and byte-pair encoding cannot be expressed in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
