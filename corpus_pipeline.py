"""Corpus cleaning pipeline: quality rules, toxicity, near-dedup, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsieve.llm import minhash, packing, quality, suffix, toxicity
from jobsieve.llm.queries import tokenizer_file
from jobsieve.session import scratch_path
from jobsieve.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the risk-controlled rules (operator 8)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the toxicity threshold (operator 4)."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


#: similarity 0.8 (operator 2's own query has 0.85); 42 bands of 6 miss a pair at 0.8 with probability 3e-6
NEAR = minhash.MinHashParams(percent=80, size=252, rows=6, batch=36)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates (operator 2) with similarity 0.8 or more."""
    return minhash.keep_one_per_group(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that occur more than once (operator 3)."""
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences (operator 9)."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: learned and approximate stages have no SQL twin; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
