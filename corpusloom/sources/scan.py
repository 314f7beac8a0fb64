"""Listing a corpus directory: ignore rules, globs, scan order, and one pipeline per format."""

from __future__ import annotations

import fnmatch
import re
import tomllib
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = ("csv", "docx", "htm", "html", "md", "pdf", "pptx", "txt", "xlsx")
IGNORED = ("__pycache__/", "node_modules/", "venv/", ".venv/", ".git/", ".corpusloom/")
IGNORE_FILE = ".corpusloomignore"


def ignore_rules(root: str | Path, gitignore: bool = True, defaults: bool = True) -> list[str]:
    """Patterns in order; the tool's own ignore file is always read."""
    lines = list(IGNORED) if defaults else []
    for name in ([".gitignore"] if gitignore else []) + [IGNORE_FILE]:
        at = Path(root, name)
        if at.exists():
            lines += at.read_text("utf-8", "replace").splitlines()
    return [x.rstrip() for x in lines if x.strip() and not x.startswith("#")]


def rule_regex(rule: str) -> tuple[bool, str]:
    """(is it a negation, regular expression over relative paths) of a gitignore line."""
    negated = rule.startswith("!")
    rule = rule[negated:]
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    out, i = "", 0
    rule = rule.lstrip("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i:]:
            j = rule.index("]", i)
            out, i = out + "[" + rule[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return negated, ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that fits decides."""
    out = F.lit(False)
    for rule in rules:
        negated, pattern = rule_regex(rule)
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def chosen(path: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Exclusion first, then inclusion (all, if no pattern is given)."""
    like = lambda p: path.rlike("(?s)^" + fnmatch.translate(p).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "") + "$")
    ok = F.lit(True)
    for p in exclude or []:
        ok &= ~like(p)
    if include:
        any_ = F.lit(False)
        for p in include:
            any_ |= like(p)
        ok &= any_
    return ok


def scan_key(path: Column) -> Column:
    """Sorts paths as a walk that lists a folder's files before its sub-folders, both by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).cast("int").alias("is_dir"), x.alias("name")))


def listing(spark: SparkSession, root: str, include_hidden: bool = False, gitignore: bool = True, defaults: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, out_dir: str | None = None) -> DataFrame:
    """source_id, path, type, length of the files to read, in scan order.  The bytes are not read here."""
    base = Path(root).resolve()
    found = [(str(p.relative_to(base)), p.stat().st_size, p.as_uri()) for p in base.rglob("*") if p.is_file()]  # names only; Spark's own listing leaves out empty files
    files = spark.createDataFrame(found, "path string, length long, uri string")
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    if not include_hidden:
        files = files.filter(~F.col("path").rlike(r"(^|/)\."))
    files = files.filter(~ignored(F.col("path"), ignore_rules(base, gitignore, defaults))).filter(chosen(F.col("path"), include, exclude))
    if out_dir:
        inside = Path(out_dir).resolve()
        if inside.is_relative_to(base):
            files = files.filter(~F.startswith(F.col("path"), F.lit(str(inside.relative_to(base)) + "/")))
    n = F.row_number().over(W.orderBy(scan_key(F.col("path")))) - 1  # file names only: a list, not a corpus
    return files.select(source_id(n).alias("source_id"), n.alias("ord"), "path", T.file_type(F.col("path")).alias("type"), "length", "uri")


def source_id(n: Column) -> Column:
    return F.format_string("src_%03d", n)


def contents(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """The listing with the files' bytes."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    data = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(Path(root).resolve())).select(plain(F.col("path")).alias("_at"), "content")
    return files.withColumn("_at", plain(F.col("uri"))).join(data, "_at", "left").drop("_at").withColumn("content", F.coalesce("content", F.lit("").cast("binary")))


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark; undecodable bytes become the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


@dataclass(frozen=True)
class Config:
    """Settings of a build; read from [pack] and [graph] of a TOML file."""

    name: str = "corpus"
    fast_pdf: bool = False
    graph: bool = True
    chunk_max_tokens: int = 800
    chunk_overlap: float = 0.15
    remove_empty_lines: bool = False
    min_docs: int = 2
    df_cap: float = 0.5
    similarity: float = 0.8
    top_concepts: int = 10


_RANGES = {"chunk_max_tokens": (1, 1_000_000), "chunk_overlap": (0.0, 0.9), "min_docs": (1, 1_000_000), "df_cap": (0.0, 1.0), "similarity": (0.0, 1.0), "top_concepts": (1, 1000)}


def load_config(folder: str | Path) -> Config:
    """Values out of range or of the wrong type are reported and replaced by the default."""
    at = Path(folder, "corpusloom.toml")
    if not at.exists():
        return Config()
    raw = tomllib.loads(at.read_text("utf-8"))
    given, out = {**raw.get("pack", {}), **raw.get("graph", {})}, {}
    for f in fields(Config):
        if f.name not in given:
            continue
        v, kind = given[f.name], type(f.default)
        lo, hi = _RANGES.get(f.name, (None, None))
        right = isinstance(v, bool) == (kind is bool) and isinstance(v, (int, float) if kind is float else kind)
        if right and (lo is None or lo <= v <= hi):
            out[f.name] = kind(v)
        else:
            warnings.warn(f"{f.name} = {v!r} is not usable; {f.default!r} is taken", stacklevel=2)
    return Config(**out)
