"""The cluster's shared folder, and sizes that follow the input."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where nothing is set (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        at = at or "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(at)
    return at or current.get()


def new_table(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder as a path that workers can open and memory-map.

    The shared folder must be mounted on every worker (file: or a plain path); other schemes are refused."""
    url = urlparse(new_table(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a shared folder that is mounted on the workers, not {url.scheme}:")
    return url.path


def text_bytes_of(df: DataFrame, text: str) -> int:
    """Bytes of all texts; sizes buckets, so that a bucket's memory is bounded at every input size."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0)


def buckets_for(nbytes: float, each: int = 24 << 20, least: int = 8) -> int:
    return max(least, -(-int(nbytes) // each))


def by_bucket(df: DataFrame, n_buckets: int, most: int = 20_000) -> GroupedData:
    """Group by ``bucket``: a partition for each, up to ``most`` partitions; beyond that a partition takes its buckets one after another."""
    return df.repartition(min(n_buckets, most), "bucket").groupBy("bucket")


def give_back(spark: SparkSession) -> None:
    """Collect garbage on the executors: their heaps shrink to what is in use, and the system gets the rest.

    A heap that grew in one stage otherwise stays that large beside the next stage's Python workers.  One task for each core, which reaches
    every executor that is idle; one that gets no task only keeps its memory, results don't depend on it."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
