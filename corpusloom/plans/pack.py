"""Building a pack from a directory, writing it, reading it again, and searching it."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, chunking, descriptors, graph, incremental, lexical, sections, vectors
from ..sources import blocks as B
from ..sources import markup
from ..sources.scan import Config, contents, decoded, listing

TABLES = ("sources", "blocks", "chunks", "tables", "warnings", "sections", "nodes", "edges", "communities")
_BLOCKS = ("source_id", "block_ord", "type", "text", "page", "section_path", "row_range")


def _csv_blocks(texts: DataFrame) -> DataFrame:
    """Rows of 50 of each CSV file, as markdown tables with 1-based row ranges."""

    def run(frames):
        import csv
        import io

        import pandas as pd

        for f in frames:
            out = []
            for s, t in zip(f["source_id"], f["text"]):
                rows = [r for r in csv.reader(io.StringIO(t)) if r]
                for i in range(1, len(rows), 50):
                    part = rows[i : i + 50]
                    lines = ["| " + " | ".join(r) + " |" for r in [rows[0], *part]]
                    out.append((s, len(out), "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]), i, i + len(part) - 1))
            yield pd.DataFrame(out, columns=["source_id", "block_ord", "text", "first", "last"]).astype({"block_ord": "int32", "first": "int32", "last": "int32"})

    rows = texts.mapInPandas(run, "source_id string, block_ord int, text string, first int, last int")
    return rows.select("source_id", "block_ord", F.lit("table").alias("type"), "text", F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("section_path"), F.struct(F.col("first").alias("start"), F.col("last").alias("end")).alias("row_range"))


def parse(files: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) of all files, one pipeline per format."""
    none = {"page": F.lit(None).cast("int"), "section_path": F.lit(None).cast("array<string>"), "row_range": F.lit(None).cast("struct<start:int,end:int>")}
    text = files.filter(F.col("type").isin("txt", "markdown", "csv")).select("source_id", "type", decoded(F.col("content")).alias("text"))
    if config.remove_empty_lines:
        text = text.withColumn("text", F.when(F.col("type") == "csv", F.col("text")).otherwise(T.compact_lines(F.col("text"))))
    txt = B.paragraphs(text.filter("type = 'txt'").drop("type"), "\n\n", "source_id").withColumns({"type": F.lit("paragraph"), **none})
    md = B.markdown(text.filter("type = 'markdown'").drop("type"), "source_id").withColumns({k: none[k] for k in ("page", "row_range")})
    table = _csv_blocks(text.filter("type = 'csv'").select("source_id", "text"))
    rest = markup.blocks(files.filter(~F.col("type").isin("txt", "markdown", "csv")))
    other = rest.filter("block_ord is not null").withColumn("row_range", none["row_range"])
    found = reduce(DataFrame.unionByName, [x.select(*_BLOCKS) for x in (txt, md, table, other)])
    ids = found.withColumn("block_id", F.format_string("%s_b%d", "source_id", "block_ord"))
    warned = B.warnings(text, "source_id").unionByName(rest.filter("warning is not null").select("source_id", F.col("warning").alias("type"), "message"))
    return ids, warned.unionByName(checks.hidden_warnings(ids))


def build(spark: SparkSession, root: str, out: str, config: Config = Config(), cached: str | None = None, **scan) -> dict[str, DataFrame]:
    """Scan, parse, chunk, map and link a directory; write every table below ``out`` and return them.

    Tables are written between the stages, so nothing is parsed twice and lost executors cost only their own tasks."""
    to = lambda name, df: _write(df, f"{out}/{name}.parquet")
    files = contents(spark, listing(spark, root, out_dir=out, **scan), root)
    files = files.withColumn("checksum", F.sha2("content", 256))
    found, warned = parse(files, config)
    blocks, warned = to("blocks", found), to("warnings", warned)
    chunks = chunking.greedy(blocks, config.chunk_max_tokens, config.chunk_overlap).withColumnRenamed("chunk_ord", "ord")
    paths = listing(spark, root, out_dir=out, **scan).select("source_id", "path")
    chunks = to("chunks", chunks.join(paths, "source_id").withColumn("section", F.try_element_at("section_path", F.lit(-1))))
    tables = to("tables", blocks.filter("type = 'table'").select("source_id", "block_id", "text", "row_range"))
    state = checks.status(files.select("source_id"), chunks, warned)
    sources = files.select("source_id", "ord", "path", "type", "length", "checksum").join(state, "source_id").join(sections.titles(blocks, F.lit(None).cast("string")), "source_id", "left")
    sources = to("sources", sources.withColumn("title", F.coalesce("title", T.human_stem(F.col("path")))))
    nodes = sections.tree(blocks.select("source_id", F.col("block_ord").alias("ord"), F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path")))
    placed = sections.attach(chunks.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>"))), nodes)
    orphans = placed.filter(F.endswith("node_id", F.lit("_root"))).select("source_id", "node_id").distinct()
    nodes = nodes.drop("first_ord").unionByName(orphans.select("source_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth"), F.lit(-1).alias("ordinal"), F.lit("(root)").alias("title"), F.array().cast("array<string>").alias("path")))
    own = placed.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "content"))), lambda x: F.struct(x["chunk_id"], x["content"])).alias("c"))
    own = own.select("node_id", F.col("c.chunk_id").alias("chunk_ids"), F.array_join(F.col("c.content"), " ").alias("text"))
    described = descriptors.describe(own, "node_id")
    secs = to("sections", nodes.join(own.select("node_id", "chunk_ids"), "node_id", "left").join(described, "node_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))))
    pack = {"sources": sources, "blocks": blocks, "chunks": chunks, "tables": tables, "warnings": warned, "sections": secs}
    if config.graph:
        pack |= link(spark, pack, out, config)
    mark = incremental.fingerprint(chunks, sources).first()[0]
    Path(out, "pack.json").write_text(json.dumps({"name": config.name, "generated_at": datetime.now(UTC).isoformat(), "fingerprint": mark, "params": {"min_docs": config.min_docs, "df_cap": config.df_cap, "similarity": config.similarity}}))
    return pack


def link(spark: SparkSession, pack: dict[str, DataFrame], out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The concept graph of a pack: nodes, edges, communities."""
    good, secs = pack["sources"].filter("status = 'success'"), pack["sections"]
    nodes, edges = graph.skeleton(good, secs)
    if good.limit(2).count() == 2:
        phrases = secs.join(good.select("source_id", F.col("title").alias("doc_title")), "source_id").select("source_id", "node_id", "doc_title", F.posexplode("keyphrases").alias("ord", "phrase"))
        contrib = graph.contributions(phrases)
        concepts = graph.promote(contrib, max(1, secs.count()), config.min_docs, config.df_cap)
        said = graph.mentions(contrib, concepts)
        deeper = secs.filter("depth > 1").join(said.select(F.col("source").alias("node_id")).distinct(), "node_id", "left_semi")
        nodes = nodes.unionByName(deeper.select(F.col("node_id").alias("id"), F.lit("section").alias("kind"), F.col("title").alias("label"), F.col("source_id").alias("doc")))
        nodes = nodes.unionByName(concepts.select(F.col("concept_id").alias("id"), F.lit("concept").alias("kind"), "label", F.lit(None).cast("string").alias("doc")))
        edges = reduce(DataFrame.unionByName, [edges, said, graph.references(pack["chunks"].select("source_id", "content"), pack["sources"])])
    edges = _write(edges, f"{out}/edges.parquet")
    of = graph.communities(nodes, edges)
    nodes = _write(nodes.join(of, "id", "left"), f"{out}/nodes.parquet")
    return {"nodes": nodes, "edges": edges, "communities": _write(graph.community_table(nodes, edges, of), f"{out}/communities.parquet")}


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{out}/{n}.parquet") for n in TABLES if Path(out, f"{n}.parquet").exists()}


def index(spark: SparkSession, out: str) -> None:
    """Postings and vectors of a pack, stamped with its fingerprint."""
    chunks = read(spark, out)["chunks"]
    _write(lexical.postings(chunks, "chunk_id", "content"), f"{out}/postings.parquet")
    _write(vectors.embed(chunks, "chunk_id", "content"), f"{out}/vectors.parquet")
    Path(out, "_fingerprint").write_text(json.loads(Path(out, "pack.json").read_text())["fingerprint"])


def search(spark: SparkSession, out: str, queries: DataFrame, mode: str = "hybrid", k: int = 5, source: str | None = None, section: str | None = None, page: int | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, source_id, path, section, page, token_count, content; a stale index is built again first.

    Filters apply after 4 * k hits are fetched."""
    if mode not in ("lexical", "vector", "hybrid"):
        raise ValueError("mode must be lexical, vector or hybrid")
    if not incremental.is_current(spark, out, json.loads(Path(out, "pack.json").read_text())["fingerprint"]):
        index(spark, out)
    wide = 4 * k if source or section or page is not None else k
    pool = 2 * wide if mode == "hybrid" else wide
    chunks = read(spark, out)["chunks"]
    lex = vec = None
    if mode != "vector":
        lex = lexical.search(chunks, queries, pool, "fallback", spark.read.parquet(f"{out}/postings.parquet"), "chunk_id", "content")
    if mode != "lexical":
        stored = spark.read.parquet(f"{out}/vectors.parquet")
        asked = vectors.embed(queries, "query_id", "query").withColumnRenamed("doc_id", "query_id")
        vec = vectors.topk(stored, asked, pool)
    hits = lex if vec is None else vec if lex is None else lexical.fuse(lex, vec, wide)
    found = hits.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score").join(chunks.drop("ord"), "chunk_id")
    found = found.withColumn("source_path", F.col("path"))
    return lexical.filtered(found, k, source, section, page).drop("rank").withColumnRenamed("place", "rank")
