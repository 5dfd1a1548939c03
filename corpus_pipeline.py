"""A training corpus in stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import small_batches
from tidemark.llm.decontaminate import find_benchmark
from tidemark.llm.line_runs import remove_repeated_lines
from tidemark.llm.near_duplicates import without_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import score_quality
from tidemark.llm.queries import END_ID, tokenizer_path
from tidemark.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the compression bands."""
    small_batches(spark)
    return score_quality(docs).where("kept").select(*docs.columns)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with no word left go."""
    cut = remove_repeated_lines(docs)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))) > 0))
    return left.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its shingles."""
    return without_near_duplicates(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # compression ratios and token ids have no SQL; tests hold each stage against plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
