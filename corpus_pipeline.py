"""A training-data pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes the documents that the one before it kept, and its decisions take effect: all stages but the last return the
columns of ``documents``.  Executors give freed memory back before each.  An empty table passes through all of them; rows with a null text fail the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, neardup, packing, quality_rules, substring
from corpusloom.llm._shared import give_back, written
from corpusloom.llm.queries import TOKENIZER, table
from corpusloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or break a certified rule go."""
    give_back(ship(spark))
    return quality_rules.keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    give_back(ship(spark))
    return neardup.keep_first(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand elsewhere too are taken out of the texts; a text that loses nothing stays as it is."""
    give_back(ship(spark))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = substring.remove_repeated(docs).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    give_back(ship(spark))
    hits = written(decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "hits")
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences of 2048 tokens."""
    give_back(ship(spark))
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark passages", benchmark_passages), ("packing", packed)]
#: Tokenising can't be expressed in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
