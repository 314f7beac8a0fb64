"""Documents as typed blocks: text paragraphs, markdown with section paths, tables in buckets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def pieces(text: Column, delimiter: str = "\n\n") -> Column:
    """Trimmed, non-empty pieces of a text, as an array."""
    return F.filter(F.transform(F.split(text, delimiter), T.strip), lambda x: x != "")


def paragraphs(docs: DataFrame, delimiter: str = "\n\n", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, block_ord, text, tokens: trimmed, non-empty pieces, numbered after empty ones are gone.  No shuffle."""
    flat = docs.select(key, F.posexplode(pieces(F.col(text_col), delimiter)).alias("block_ord", "text"))
    return flat.withColumn("tokens", T.token_count(F.col("text")))


def warnings(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, type, message: bytes that could not be decoded, and files without content."""
    bad = F.when(F.contains(F.col(text_col), F.lit("�")), F.lit("decode_error"))
    empty = F.when(F.coalesce(F.length(T.strip(F.col(text_col))), F.lit(0)) == 0, F.lit("empty_file"))
    out = docs.select(key, F.explode(F.array_compact(F.array(bad, empty))).alias("type"))
    return out.withColumn("message", F.when(F.col("type") == "empty_file", "no text in the file").otherwise("some bytes are not UTF-8 and were replaced"))


def push_heading(stack: Column, level: Column, title: Column) -> Column:
    """The path after a heading: cut to level - 1 entries by position, then the title (a skipped level leaves no gap)."""
    return F.concat(F.slice(stack, F.lit(1), F.least(level - 1, F.size(stack))), F.array(title))


def markdown(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, block_ord, type, text, section_path: headings and the paragraphs between them, in order.

    The running path is a fold over the headings of one document; lines of a paragraph are joined, blank lines separate."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(#+) ", 1)
    lines = lines.withColumn("level", F.length(head)).withColumn("title", F.when(F.col("level") > 0, T.strip(F.regexp_replace("line", r"^#+ ", ""))))
    blank = T.strip(F.col("line")) == ""
    w = W.partitionBy(key).orderBy("pos")
    starts = (F.col("level") > 0) | blank | F.lag((F.col("level") > 0) | blank, 1, True).over(w)
    lines = lines.withColumn("part", F.sum(starts.cast("int")).over(w)).filter(~blank)
    heads = F.collect_list(F.when(F.col("level") > 0, F.struct("level", "title"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    path = F.aggregate(heads, F.array().cast("array<string>"), lambda acc, h: push_heading(acc, h["level"].cast("int"), h["title"]))
    lines = lines.withColumn("section_path", path)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", T.strip(F.coalesce("title", "line")).alias("t")))), lambda x: x["t"]), " ")
    blocks = lines.groupBy(key, "part").agg(F.min("pos").alias("pos"), F.when(F.max("level") > 0, "heading").otherwise("paragraph").alias("type"), text.alias("text"), F.max("section_path").alias("section_path"))
    return blocks.withColumn("block_ord", F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).select(key, "block_ord", "type", "text", "section_path")


def row_buckets(table: DataFrame, columns: list[str], order: str, key: Column | None = None, size: int = 50) -> DataFrame:
    """source, bucket, first_row, last_row, text: markdown tables of ``size`` rows with 1-based inclusive row ranges."""
    key = F.lit("table") if key is None else key
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = table.select(key.alias("source"), line.alias("line"), F.col(order).alias("ord"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("ord")))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("source", F.floor((F.col("rn") - 1) / size).alias("bucket")).agg(F.min("rn").alias("first_row"), F.max("rn").alias("last_row"), body.alias("b"))
    return out.select("source", "bucket", "first_row", "last_row", F.concat(F.lit(head + "\n"), "b").alias("text"))
