"""Validation, audit, status and content trust as DataFrames of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Findings that mean a source gave nothing come first.
FIRST_TYPES = ("parse_error", "import_error")


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, what: str) -> DataFrame:
    """check, key: values of ``child`` without a row in ``parent``."""
    p = parent.select(F.col(parent_key).alias("_k"))
    return child.join(p, child[key] == p["_k"], "left_anti").select(F.lit(what).alias("check"), F.col(key).cast("string").alias("key"))


def too_long(chunks: DataFrame, most: int = 4000, key: str = "chunk_id") -> DataFrame:
    return chunks.filter(F.col("token_count") > most).select(F.lit("tokens").alias("check"), F.col(key).cast("string").alias("key"))


def required_columns(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n not in df.columns]


def validate(pack: dict[str, DataFrame], most: int = 4000) -> DataFrame:
    """Every broken reference and every chunk that is too long, as (check, key).

    pack: sources, chunks, tables and, if there, sections (with chunk_ids), nodes, edges."""
    for name, cols in {"sources": ("source_id", "path"), "chunks": ("chunk_id", "source_id", "token_count"), "tables": ("source_id",)}.items():
        if name not in pack or required_columns(pack[name], cols):
            raise ValueError(f"the pack needs a table {name} with columns {cols}")
    sources, chunks = pack["sources"], pack["chunks"]
    found = [missing_keys(chunks, "source_id", sources, "source_id", "chunk_source"), missing_keys(pack["tables"], "source_id", sources, "source_id", "table_source"), too_long(chunks, most)]
    if "sections" in pack:
        s = pack["sections"]
        found.append(missing_keys(s, "source_id", sources, "source_id", "section_source"))
        if "chunk_ids" in s.columns:
            found.append(missing_keys(s.select(F.explode("chunk_ids").alias("chunk_id")), "chunk_id", chunks, "chunk_id", "section_chunk"))
    if "nodes" in pack and "edges" in pack:
        n, e = pack["nodes"], pack["edges"]
        found.append(missing_keys(n.filter("kind = 'document'"), "id", sources, "source_id", "node_document"))
        found.append(missing_keys(n.filter("doc is not null"), "doc", sources, "source_id", "node_doc"))
        if "sections" in pack:
            found.append(missing_keys(n.filter("kind = 'section'"), "id", pack["sections"], "node_id", "node_section"))
        found += [missing_keys(e, side, n, "id", f"edge_{side}") for side in ("source", "target")]
        if "communities" in pack and "community" in n.columns:
            found.append(missing_keys(n.filter("community is not null"), "community", pack["communities"], "community", "node_community"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def status(sources: DataFrame, chunks: DataFrame, warnings: DataFrame, key: str = "source_id") -> DataFrame:
    """key, n_chunks, status, reason: failed with a parse error or without chunks."""
    n = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    errors = warnings.filter("type = 'parse_error'").groupBy(key).agg(F.min("message").alias("error"))
    out = sources.select(key).join(n, key, "left").join(errors, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    failed = F.col("error").isNotNull() | (F.col("n_chunks") == 0)
    return out.select(key, "n_chunks", F.when(failed, "failed").otherwise("success").alias("status"), F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_chunks") == 0, "produced 0 chunks").alias("reason"))


def audit(sources: DataFrame, chunks: DataFrame, tables: DataFrame, order: str = "ord") -> DataFrame:
    """One row: n_sources, n_chunks, n_tables, n_tokens, max_tokens, largest (the first of the longest chunks; null if all are empty)."""
    a = sources.agg(F.count("*").alias("n_sources"))
    largest = F.when(F.max("token_count") > 0, F.max_by("chunk_id", F.struct("token_count", -F.col(order))))
    b = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"), largest.alias("largest"))
    return a.crossJoin(b).crossJoin(tables.agg(F.count("*").alias("n_tables")))  # three single rows


def warning_summary(warnings: DataFrame) -> DataFrame:
    """type, n, place: errors first, then by name."""
    first = F.array(*[F.lit(x) for x in FIRST_TYPES])
    at = F.array_position(first, F.col("type"))
    return warnings.groupBy("type").agg(F.count("*").alias("n")).withColumn("place", F.when(at > 0, at).otherwise(len(FIRST_TYPES) + 1))


def hidden_characters(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Blocks with invisible characters and how many of each kind."""
    counts = T.hidden_counts(F.col(text_col))
    out = blocks.withColumns(counts)
    some = F.lit(False)
    for name in counts:
        some |= F.col(name) > 0
    return out.filter(some)


def hidden_warnings(blocks: DataFrame, key: str = "source_id", block: str = "block_id") -> DataFrame:
    """key, type, message: one finding for each block."""
    found = hidden_characters(blocks)
    parts = [F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n.replace('_', ' ')}"))) for n in T.HIDDEN]
    return found.select(key, F.lit("unicode_smuggling").alias("type"), F.concat(F.lit("block "), F.col(block).cast("string"), F.lit(": "), F.concat_ws(", ", *parts), F.lit(" character(s) that a reader can't see")).alias("message"))
