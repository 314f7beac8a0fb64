"""Quality rules whose cutoffs are chosen with a bound on the good documents that they reject."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._words import Words, per_row, rolling, slices, starts_of_windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: rule -> (numerator, denominator); a document breaks the rule at a cutoff of c if 100 * numerator > c * denominator.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "long_words": ("word_chars", "n_words"),
}
#: Cutoffs tried for each rule, strictest first, in percent.  Fixed in advance, so that the tests need no other split.
GRID = {"symbols": (5, 10, 20, 40, 80), "repeats": (1, 2, 5, 10, 20), "dup_lines": (5, 10, 20, 40, 60), "long_words": (700, 800, 1000, 1500, 3000)}


def _features(window: int):
    def run(batches):
        for b in slices(batches, 1, 2 << 20, 1 << 11):
            w = Words(b.column(1))
            rows = b.num_rows
            nbytes = len(w.buf)
            cp = np.zeros(nbytes + 1, np.int64)
            np.cumsum((w.buf & 0xC0) != 0x80, out=cp[1:])
            chars = per_row(cp[w.start + w.length] - cp[w.start], w.first)
            sy = np.zeros(nbytes + 1, np.int64)
            np.cumsum(_SYMBOL[w.buf], out=sy[1:])
            symbols = sy[w.off[1:]] - sy[w.off[:-1]]
            repeats = np.zeros(rows, np.int64)
            h = rolling(w.hashes(), window)
            at = np.flatnonzero(starts_of_windows(w.first, window, len(w)))
            if len(at):
                row = w.row
                key = ((row[at].astype(np.uint64) << np.uint64(53)) | (h[at] >> np.uint64(11)))  # at most 2048 rows in a slice
                s = np.sort(key)
                twice = s[1:][s[1:] == s[:-1]]
                if len(twice):
                    twice = np.unique(twice)
                    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                    hit = at[twice[near] == key]
                    delta = np.zeros(len(w) + window + 1, np.int64)
                    np.add.at(delta, hit, 1), np.add.at(delta, hit + window, -1)
                    repeats = per_row((np.cumsum(delta)[: len(w)] > 0).astype(np.int64), w.first)
            dup, lines = _lines(w, b.column(1))
            cols = [w.counts, chars, symbols, dup, repeats, lines]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c.astype(np.int64)) for c in cols]], names=_OUT.replace(" long", "").split(", "))

    return run


def _lines(w: Words, col) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word equal to an earlier line, and lines with a word, of each row.  Only rows with a newline need a look."""
    dup = np.zeros(len(w.counts), np.int64)
    lines = (w.counts > 0).astype(np.int64)
    nl = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.buf == 10, out=nl[1:])
    for r in np.flatnonzero(nl[w.off[1:]] > nl[w.off[:-1]]):
        own = [x for x in w.buf[w.off[r] : w.off[r + 1]].tobytes().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines[r], dup[r] = len(own), len(own) - len(set(own))
    return dup, lines


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.  Null: no words."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(_features(window), _OUT)


def tail_at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 1.0
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def accepted(k: int, n: int, alpha: float, delta: float) -> bool:
    """Is the exact (Clopper-Pearson) upper bound of a rate, k of n seen, at confidence 1 - delta, at most alpha?"""
    return n > 0 and k <= alpha * n and tail_at_most(k, n, alpha) <= delta


def _width(sizes: tuple[int, ...]) -> int:
    """The largest number of combinations of which none is at least as strict as another, of rules with so many depths each."""
    ranks = np.ones(1, np.int64)
    for n in sizes:
        ranks = np.convolve(ranks, np.ones(n, np.int64))
    return int(ranks.max())


def _chains() -> list[list[tuple[int, ...]]]:
    """For each rule a sequence of ever stricter combinations: its own cutoffs first, then those of the other rules in turn."""
    names = sorted(RULES)
    out = []
    for first in range(len(names)):
        depth, steps = [0] * len(names), []
        for r in (*range(first, len(names)), *range(first)):
            for d in range(1, len(GRID[names[r]]) + 1):
                depth[r] = d
                steps.append(tuple(depth))
        out.append(steps)
    return out


def choose(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> dict[str, int]:
    """rule -> cutoff of one stratum, so that all rules together are certified to lose at most ``alpha`` of its good documents.

    levels: for each cell and rule (by name) how many cutoffs the cell's documents break; good, bad: labelled documents in it.  A combination of
    cutoffs is tested by the exact binomial bound on the good documents that any of its rules rejects.

    Of uncertifiable combinations those that aren't stricter than another such form a set of which none is stricter than another, and a
    stricter combination never loses fewer documents of the holdout.  So if every test has the level ``delta`` / width, where the width is the
    size of the largest such set, the probability that any uncertifiable one passes is at most ``delta``, whichever are tested and in
    whatever order.  Where the holdout can reach that level for all combinations, the search is greedy: the step that
    catches most bad documents (then loses fewest good ones) is taken until no step is certified.  Where it can't, only the
    combinations of a sequence for each rule are tested (``_chains``), each until the first that fails: their width is the number of
    rules; the certified combination that catches most bad documents stays, then the one with most cutoffs tightened."""
    names = sorted(RULES)
    size = np.array([len(GRID[r]) for r in names])
    n = int(good.sum())

    def caught(depth: tuple[int, ...], count: np.ndarray) -> int:
        return int(count[(levels > size - np.array(depth)).any(axis=1)].sum())

    full = _width(tuple(size + 1))
    best = (0,) * len(names)
    if accepted(0, n, alpha, delta / full):
        while True:
            steps = [best[:i] + (best[i] + 1,) + best[i + 1 :] for i in range(len(names)) if best[i] < size[i]]
            steps = [(caught(d, bad), -caught(d, good), d) for d in steps if accepted(caught(d, good), n, alpha, delta / full)]
            if not steps:
                break
            best = max(steps)[2]
    elif accepted(0, n, alpha, delta / len(names)):
        found = [best]
        for chain in _chains():
            for d in chain:
                if not accepted(caught(d, good), n, alpha, delta / len(names)):
                    break
                found.append(d)
        best = max(found, key=lambda d: (caught(d, bad), sum(d), d))
    return {r: GRID[r][len(GRID[r]) - d] for r, d in zip(names, best) if d}


def labels_needed(alpha: float, delta: float) -> int:
    """Fewer good documents than this can't certify anything, whatever is seen."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def _breaks(rule: str, cutoff) -> F.Column:
    num, den = RULES[rule]
    return 100 * F.col(num) > cutoff * F.col(den)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _chooser(alpha: float, delta: float):
    names = sorted(RULES)

    def run(table: pa.Table) -> pa.Table:
        levels = np.stack([table[f"l{i}"].to_numpy() for i in range(len(names))], axis=1)
        q, c = table["quality"].to_numpy(), table["c"].to_numpy()
        got = choose(levels, np.where(q == 1, c, 0), np.where(q == 1, 0, c), alpha, delta / int(table["strata"][0].as_py()))
        return pa.table({"stratum": table["stratum"][:1].cast(pa.string()), **{f"cut_{r}": pa.array([got.get(r)], pa.int64()) for r in names}})

    return run


def _stratum(col: str) -> F.Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, alpha: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """Features of all documents, written; and the chosen cutoffs, a row for each stratum that has any, written."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _stratum(stratum_col).alias("stratum"))
    feats = written(_with_stratum(src), "features").withColumn("base_failed", base_failed())
    told = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    level = lambda r: F.when(F.col("base_failed"), F.lit(0)).otherwise(sum((_breaks(r, c).cast("int") for c in GRID[r]), F.lit(0)))
    names = [f"l{i}" for i in range(len(RULES))]
    cells = feats.join(told, "doc_id").select("stratum", "quality", *[level(r).alias(x) for r, x in zip(sorted(RULES), names)]).groupBy("stratum", "quality", *names).agg(F.count("*").alias("c"))
    cells = written(cells, "cells")
    able = cells.filter("quality = 1").groupBy("stratum").agg(F.sum("c").alias("n")).filter(F.col("n") >= labels_needed(alpha, delta)).select("stratum")
    strata = able.count()
    cuts = cells.join(able, "stratum", "left_semi").withColumn("strata", F.lit(strata)).groupBy("stratum").applyInArrow(_chooser(alpha, delta), "stratum string, " + ", ".join(f"cut_{r} long" for r in sorted(RULES)))
    return feats, written(cuts, "cutoffs")


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Verdicts: doc_id, the counts of ``features``, base_failed, kept, stratum, broken (names of the rules broken).

    Holdout: the documents with a row of ``labels`` of quality 1.  With probability 1 - ``delta`` every stratum loses at most ``alpha`` of its
    good documents to the chosen rules (those that fail the base test, which is not up for choice, count as not lost to them).
    Strata whose good labels are too few to certify anything (``labels_needed``) lose nothing by rules and aren't tested; the
    others share ``delta`` in equal parts (Bonferroni), and ``choose`` corrects for the cutoffs tried.  Null strata form one of their own.
    Null and empty texts have no words and fail the base test.  A document that stands repeated is judged each time; a label
    that stands repeated counts once, and one of both qualities as good.  Other columns aren't looked at; of an empty table nothing comes back.

    Plan: features once, written as numbers; labels join on the id; cells of equal levels are counted, and each stratum's cutoffs
    are chosen from at most 2592 of them in Spark; the cutoffs, a row a stratum, join back.  Nothing by stratum reaches the driver."""
    feats, cuts = _fit(docs, labels, id_col, text_col, stratum_col, alpha, delta)
    rules = sorted(RULES)
    feats = feats.join(cuts, "stratum", "left").withColumn("broken", F.array_compact(F.array(*[F.when(_breaks(r, F.col(f"cut_{r}")), F.lit(r)) for r in rules])))
    names = [c for c in _OUT.replace(" long", "").split(", ")]
    return feats.select(*names, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "stratum", "broken")


def _with_stratum(src: DataFrame) -> DataFrame:
    inner = _features(8)

    def run(batches):
        for b in slices(batches, 1, 2 << 20, 1 << 11):
            for out in inner(iter([b.select(["doc_id", "text"])])):
                yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], names=[*out.schema.names, "stratum"])

    return src.mapInArrow(run, _OUT + ", stratum string")


def _keep(width: int):
    inner = _features(8)
    rules = sorted(RULES)

    def run(batches):
        for b in slices(batches, 1, 2 << 20, 1 << 11):
            f = pa.Table.from_batches(inner(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(1)], names=["doc_id", "text"])])))
            n = {c: f[c].to_numpy() for c in f.schema.names}
            ok = (n["n_words"] >= 20) & (100 * n["n_repeat_words"] <= 30 * n["n_words"])
            for i, r in enumerate(rules):
                num, den = RULES[r]
                cut = b.column(width + i)
                ok &= ~(np.asarray(cut.is_valid()) & (100 * n[num] > cut.fill_null(0).to_numpy() * n[den]))
            yield b.filter(pa.array(ok)).select(range(width))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows that ``filter_quality`` keeps, with all their columns; nulls, empty texts, repeated rows and empty tables as there.

    Once cutoffs are chosen a second pass judges each row where it stands: the cutoffs, a row for each stratum that has any, join by
    their measured size, so texts are shuffled only if there are more strata than can be broadcast."""
    _, cuts = _fit(docs, labels, id_col, text_col, stratum_col, alpha, delta)
    order = [id_col, text_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    src = docs.select(*[F.col(f"`{c}`") for c in order])
    cuts = cuts.select(F.col("stratum").alias("__stratum"), *[F.col(f"cut_{r}").alias(f"__{r}") for r in sorted(RULES)])
    met = src.join(cuts, _stratum(stratum_col) == F.col("__stratum"), "left").select(*[F.col(f"`{c}`") for c in order], *[F.col(f"__{r}") for r in sorted(RULES)])
    return met.mapInArrow(_keep(len(order)), src.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
