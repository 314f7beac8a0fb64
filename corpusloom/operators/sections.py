"""The section tree: an adjacency table built from paths, with ids, roll-ups and chunk attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tree(items: DataFrame, depth: int | None = None) -> DataFrame:
    """source_id, node_id, parent_id, depth, ordinal, title, path of every section.

    items: source_id, ord, section_path.  Every prefix of a path is a section; siblings are numbered in order of first appearance.  One step
    for each level; levels are few."""
    pre = items.filter(F.size("section_path") > 0).select("source_id", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda i: F.slice("section_path", F.lit(1), i))).alias("path"))
    nodes = pre.groupBy("source_id", "path").agg(F.min("ord").alias("first_ord")).withColumn("depth", F.size("path"))
    up = F.when(F.col("depth") > 1, F.slice("path", F.lit(1), F.col("depth") - 1)).otherwise(F.array().cast("array<string>"))
    nodes = nodes.withColumn("up", up)
    nodes = nodes.withColumn("ordinal", F.row_number().over(W.partitionBy("source_id", "up").orderBy("first_ord", "path")) - 1)
    nodes = nodes.select("source_id", "path", "up", "depth", "first_ord", "ordinal", F.element_at("path", -1).alias("title"))
    if depth is None:
        depth = nodes.agg(F.max("depth")).first()[0] or 0
    level, out = None, None
    for d in range(1, depth + 1):
        at = nodes.filter(F.col("depth") == d)
        if level is None:
            at = at.withColumn("parent_id", F.lit(None).cast("string")).withColumn("node_id", F.format_string("%s_s%02d", F.col("source_id").cast("string"), F.col("ordinal")))
        else:
            at = at.join(level.select("source_id", F.col("path").alias("up"), F.col("node_id").alias("parent_id")), ["source_id", "up"]).withColumn("node_id", F.format_string("%s-%02d", F.col("parent_id"), F.col("ordinal")))
        level = at.select("source_id", "node_id", "parent_id", "depth", "ordinal", "title", "path", "first_ord")
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = nodes.select("source_id", F.lit("").alias("node_id"), F.lit("").alias("parent_id"), "depth", "ordinal", "title", "path", "first_ord")
    return out


def attach(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks with the node of their full path; those without one go to the source's orphan root."""
    own = nodes.select("source_id", F.col("path").alias("section_path"), "node_id")
    return chunks.join(own, ["source_id", "section_path"], "left").withColumn("node_id", F.coalesce("node_id", F.concat(F.col("source_id").cast("string"), F.lit("_root"))))


def page_spans(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """node_id, first_page, last_page over each subtree.  pages: source_id, section_path, page.  An item counts for all prefixes of its path."""
    pre = pages.filter("page is not null and size(section_path) > 0").select("source_id", "page", F.explode(F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda i: F.slice("section_path", F.lit(1), i))).alias("path"))
    spans = pre.groupBy("source_id", "path").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return nodes.join(spans, ["source_id", "path"], "left").select("node_id", "first_page", "last_page")


def statistics(items: DataFrame, keys: list[str], sums: dict[str, F.Column]) -> DataFrame:
    """Counts per source and for the corpus (null keys) in one pass."""
    return items.rollup(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def titles(blocks: DataFrame, path_title: F.Column, key: str = "source_id") -> DataFrame:
    """The first heading, else the file's stem in words."""
    return blocks.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("type") == "heading", F.col("text")), F.when(F.col("type") == "heading", F.col("block_ord"))), F.min(path_title)).alias("title"))


def nested(nodes: list[dict]) -> list[dict]:
    """Rows of one source as nested dictionaries, for export."""
    by, roots = {}, []
    for n in sorted(nodes, key=lambda r: (r["depth"], r["ordinal"])):
        by[n["node_id"]] = node = {**n, "nodes": []}
        (by[n["parent_id"]]["nodes"] if n["parent_id"] in by else roots).append(node)
    return roots
