"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of their input. ``run`` stores each stage's result in the shared folder and reads it
again, so a lost executor repeats at most one stage's tasks.

Defined cases: null, empty and short texts fail the quality rules and go; texts of any length are processed whole. Rows
without a doc_id go through all stages and are never near-duplicates. Of texts that are near or equal copies the one
of least doc_id stays; of rows that repeat a doc_id and text one stays; rows of one doc_id with other texts are
documents of their own. Extra columns stay up to the last stage, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillrec.llm import common, decontaminate, line_spread, minhash, pieces, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites."""
    return line_spread.remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return pieces.encode_decode(docs, pieces.default_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_codes", sentencepiece_codes),
]

#: SentencePiece pieces can't be expressed in SQL; tests/llm holds the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
