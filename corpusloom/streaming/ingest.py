"""Structured Streaming extensions: windowed counts, sessions, incremental ingest by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's is pinned to UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Tumbling windows of counts and sums per type; rows later than the watermark are dropped in a stream."""
    w = event_time(events, column).withWatermark(column, late).groupBy(F.window(column, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    s = event_time(events, column).withWatermark(column, late).groupBy(F.session_window(column, gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(docs: DataFrame, late: str = "1 day", column: str = "ts") -> DataFrame:
    """Each content once within the watermark."""
    return docs.withColumn("key", F.sha2("text", 256)).withWatermark(column, late).dropDuplicatesWithinWatermark(["key"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Take up new text files of a folder: contents not in ``table`` yet are appended, with their hash as key; then stop.

    A batch that is run again finds its own rows and appends nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        new = batch.select(F.col("path"), F.sha2("content", 256).alias("key"), F.col("content").cast("string").alias("text")).dropDuplicates(["key"])
        try:
            old = spark.read.parquet(table).select("key")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        (new if old is None else new.join(old, "key", "left_anti")).write.mode("append").parquet(table)

    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what there is into a memory table and return it."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
