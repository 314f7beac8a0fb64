"""Incremental builds: content hashes, misses, fingerprints, and an append-only feedback table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def split_by_cache(items: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that are wanted, items that the cache lacks, each key once)."""
    wanted = items.select(key).distinct()
    return cache.join(wanted, key, "left_semi"), items.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent or unreadable cache is an empty one; reading never creates it."""
    empty = spark.createDataFrame([], schema)
    if not any(Path(path).glob("*.parquet")):
        return empty
    try:
        found = spark.read.parquet(path)
        return found.select(*empty.columns) if set(empty.columns) <= set(found.columns) else empty
    except Exception:  # a damaged cache is built again
        return empty


def fingerprint(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted chunk ids with token counts and the sorted checksums.

    Gathers one short string per chunk; it stands for a pack, so it is computed once per build."""
    a = chunks.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("token_count").cast("string")))), "|").alias("a"))
    b = sources.agg(F.array_join(F.array_sort(F.collect_list("checksum")), "|").alias("b"))
    return a.crossJoin(b).select(F.sha2(F.concat_ws("||", "a", "b"), 256).alias("fingerprint"))


def is_current(spark: SparkSession, path: str, now: str) -> bool:
    """Was the index at ``path`` built from the pack with this fingerprint?"""
    at = Path(path, "_fingerprint")
    return at.exists() and at.read_text() == now


FEEDBACK = PT.StructType([PT.StructField("chunk_id", PT.StringType()), PT.StructField("query", PT.StringType()), PT.StructField("rating", PT.IntegerType()), PT.StructField("ts", PT.DoubleType())])
RATINGS = (-1, 1, 2)


def append_feedback(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    bad = [r for r in rows if r[2] not in RATINGS]
    if bad:
        raise ValueError(f"a rating must be one of {RATINGS}: {bad[:3]}")
    spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.mode("append").parquet(path)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    count = lambda v, n: F.count_if(F.col("rating") == v).alias(n)
    return feedback.groupBy("chunk_id").agg(count(1, "n_up"), count(-1, "n_down"), count(2, "n_saved"), F.count("*").alias("n"), F.sum("rating").alias("total"))
