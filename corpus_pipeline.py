"""From raw documents to a training mix: the stages in order, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabgauge.llm import decontaminate, line_templates, mixing, quality, simhash
from tabgauge.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that fail and the documents that are rejected."""
    return with_text(quality.clean_lines(docs).filter("kept"), F.col("clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates. A document left without a word by it was nothing but such lines and goes."""
    cleaned = line_templates.drop_templates(docs)
    gone = (F.col("n_dropped") > 0) & ~F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")
    return with_text(cleaned.filter(~gone), F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_hits(docs, benchmark).filter(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Serve documents by the target weights: a row for each document, with how often it is served."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: SQL has no SimHash; the pipeline is tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
