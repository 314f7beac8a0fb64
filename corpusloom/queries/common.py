"""Registration of queries with their oracle SQL, and SQL snippets that say what the expressions in ``functions`` say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


BLANK = r"[\x09-\x0D\x20]"
STRIP = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
TOKENS = lambda c: rf"CAST(coalesce(len(regexp_extract_all({c}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')), 0) AS INTEGER)"
WORDS = lambda c: rf"coalesce(regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}]+'), [])"
SLUG = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
