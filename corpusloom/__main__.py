"""Command line: pack, index, retrieve, validate, audit, map, graph, eval."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from .functions import text as T
from .operators import checks, evaluation
from .plans import export, pack
from .session import build
from .sources.scan import load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("pack", help="build a pack from a folder")
    c.add_argument("folder"), c.add_argument("--out", required=True)
    c.add_argument("--include", action="append"), c.add_argument("--exclude", action="append")
    c.add_argument("--include-hidden", action="store_true"), c.add_argument("--no-gitignore", action="store_true"), c.add_argument("--no-defaults", action="store_true"), c.add_argument("--no-graph", action="store_true")
    for name, text in {"index": "build the search indexes", "validate": "report broken references", "audit": "print the audit", "map": "print the section tree", "graph": "build the graph again and print its report"}.items():
        sub.add_parser(name, help=text).add_argument("pack")
    r = sub.add_parser("retrieve", help="search a pack")
    r.add_argument("pack"), r.add_argument("query"), r.add_argument("-k", type=int, default=5)
    r.add_argument("--mode", choices=("lexical", "vector", "hybrid"), default="hybrid"), r.add_argument("--source"), r.add_argument("--section"), r.add_argument("--page", type=int)
    e = sub.add_parser("eval", help="metrics of all modes against gold evidence (JSON lines: query_id, query, gold: [{file, section}])")
    e.add_argument("pack"), e.add_argument("queries")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build("corpusloom")
    if a.command == "pack":
        config = load_config(a.folder)
        config = replace(config, graph=config.graph and not a.no_graph)
        built = pack.build(spark, a.folder, a.out, config, include_hidden=a.include_hidden, gitignore=not a.no_gitignore, defaults=not a.no_defaults, include=a.include, exclude=a.exclude)
        print(json.dumps({n: df.count() for n, df in built.items()}))
        return 0
    p = pack.read(spark, a.pack)
    if a.command == "index":
        pack.index(spark, a.pack)
    elif a.command == "validate":
        bad = checks.validate(p).limit(1000).collect()
        print("\n".join(f"{r.check}: {r.key}" for r in bad) or "valid")
        return int(bool(bad))
    elif a.command == "audit":
        print(export.audit_report(p, a.pack))
    elif a.command == "map":
        print(export.map_json(p))
    elif a.command == "graph":
        kept = json.loads(Path(a.pack, "pack.json").read_text())["params"]  # the pack's own settings win
        p |= pack.link(spark, p, a.pack, replace(load_config(a.pack), **kept))
        print(export.graph_report(p))
    elif a.command == "retrieve":
        q = spark.createDataFrame([(1, a.query)], "query_id long, query string")
        hits = pack.search(spark, a.pack, q, a.mode, a.k, a.source, a.section, a.page)
        cite = T.citation(F.col("path"), F.col("page"), F.try_element_at("row_range", F.lit(1)), F.try_element_at("row_range", F.lit(2)), F.col("section"))
        for r in hits.select("rank", cite.alias("cite"), "chunk_id", "token_count", "score", "content").orderBy("rank").collect():
            print(f"{r['rank']}. {r.cite}\n   {r.chunk_id}, {r.token_count} tokens, score {r.score:.4f}\n   {' '.join(r.content.split())[:300]}")
    else:
        raw = spark.read.schema("query_id long, query string, gold array<struct<file:string,section:string>>").json(a.queries)
        gold = raw.select("query_id", F.explode("gold").alias("g")).select("query_id", "g.*")
        modes, out = ("lexical", "vector", "hybrid"), None
        for m in modes:
            hits = pack.search(spark, a.pack, raw.select("query_id", "query"), m, 3).select(F.lit(m).alias("mode"), "query_id", "rank", F.col("path").alias("file"), "section", "token_count")
            out = hits if out is None else out.unionByName(hits)
        asked = raw.select("query_id").crossJoin(spark.createDataFrame([(m,) for m in modes], "mode string"))  # three modes
        for r in evaluation.summary(evaluation.per_query(evaluation.relevant(out, gold), asked)).orderBy("mode").collect():
            print(json.dumps(r.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
