"""Exports of a pack for people: chunk and table files, a nested map, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, graph, sections


def files(rows: DataFrame, name: str, text: str, folder: str) -> None:
    """One markdown file for each row, written by the workers (the folder must be shared)."""

    def write(part):
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in part:
            Path(folder, f"{r[0]}.md").write_text(r[1] or "", "utf-8")

    rows.select(name, text).foreachPartition(write)


def map_json(pack: dict[str, DataFrame]) -> str:
    """The section tree of each document, nested."""
    by: dict[str, list[dict]] = {}
    for r in pack["sections"].orderBy("source_id", "depth", "ordinal").toLocalIterator():
        by.setdefault(r["source_id"], []).append(r.asDict(recursive=True))
    docs = [{"source_id": r["source_id"], "path": r["path"], "title": r["title"], "sections": sections.nested(by.get(r["source_id"], []))} for r in pack["sources"].orderBy("ord").toLocalIterator()]
    return json.dumps({"documents": docs}, ensure_ascii=False, indent=1)


def audit_report(pack: dict[str, DataFrame], name: str) -> str:
    a = checks.audit(pack["sources"], pack["chunks"], pack["tables"]).first()
    lines = [f"# Audit of {name}", "", f"- sources: {a.n_sources}", f"- chunks: {a.n_chunks}", f"- tables: {a.n_tables}", f"- tokens: {a.n_tokens}", f"- longest chunk: {a.max_tokens} tokens ({a.largest})", "", "## Warnings"]
    found = checks.warning_summary(pack["warnings"]).orderBy("place", "type").collect()  # a row for each type
    for w in found:
        lines.append(f"- {w.type}: {w.n}")
        lines += [f"  - {r.source_id}: {r.message}" for r in pack["warnings"].filter(F.col("type") == w.type).orderBy("source_id").limit(100).collect()]
    return "\n".join(lines if found else [*lines, "- none"]) + "\n"


def graph_report(pack: dict[str, DataFrame], top: int = 10) -> str:
    n, e = pack["nodes"], pack["edges"]
    of = n.filter("community is not null").select("id", "community")
    lines = ["# Graph", "", "## Concepts"] + [f"- {r.concept_id}: {r.degree}" for r in graph.top_concepts(e, top).collect()]
    lines += ["", "## Bridges"] + [f"- {r.concept_id}: {r.n_communities} communities" for r in graph.bridges(e, of).orderBy(F.col("n_communities").desc(), "concept_id").limit(100).collect()]
    lines += ["", "## Isolated documents"] + [f"- {r.id}: {r.label}" for r in graph.isolated(n, e).orderBy("id").limit(100).collect()]
    lines += ["", "## Communities"] + [f"- {r.community}: {r.n_document} documents, {r.n_section} sections, {r.n_concept} concepts" for r in graph.kinds_by_community(n, of).orderBy("community").limit(100).collect()]
    return "\n".join(lines) + "\n"
