"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, mix, rolling, slices, starts_of_windows

_OUT = "doc_id long, item_id long, n_shingles long, n_matched long, containment double"


def _shingles(w: Words, r: int, k: int) -> set[bytes]:
    words = [w.word(i) for i in range(w.first[r], w.first[r + 1])]
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _text_words(col: pa.Array) -> Words:
    return Words(pc.utf8_lower(col.cast(pa.string())), lower=True, punctuation=True)


def _hashes(h: np.ndarray, k: int) -> np.ndarray:
    return mix(rolling(h, k), 99)


def index_items(texts: list[str], k: int, threshold: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sketches of test items by size partition: (shingle length, power of two, sorted sketch hashes, their items).

    Partition: shingle length (``k``, or an item's own length where it has fewer words) and power of two of the shingle count.
    An item of n shingles, of which at least threshold * n must be in a document, may miss at most m = n - ceil(threshold * n);
    its m + 1 smallest hashes (a bottom-(m+1) MinHash sketch) can't all be missing, so the search overlooks nothing.
    The sketch length of a partition's largest item holds for the partition."""
    w = _text_words(pa.array(texts, pa.string()))
    h, out = w.hashes(), []
    for own in range(1, k + 1):
        s = _hashes(h, own)
        rows = (w.counts >= k) if own == k else (w.counts == own)
        ok = starts_of_windows(w.first, own, len(w))
        at = np.flatnonzero(ok & rows[w.row[: len(ok)]]) if len(ok) else np.empty(0, np.int64)
        row, s = w.row[at], s[at]
        order = np.lexsort((s, row))
        row, s = row[order], s[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1])]) if len(row) else np.empty(0, bool)
        row, s = row[new], s[new]
        n = np.bincount(row, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        part = np.array([int(x).bit_length() for x in n])
        for p in np.unique(part[n > 0]):
            most = int(n[part == p].max())
            size = most - int(np.ceil(threshold * most - 1e-9)) + 1
            mine = (part[row] == p) & (np.arange(len(row)) - first[row] < size)
            o = np.argsort(s[mine], kind="stable")
            out.append((own, int(p), s[mine][o], row[mine][o].astype(np.int64)))
    return out


def _search(shared, k: int, threshold: float):
    def run(batches):
        ids, texts, parts = shared.value
        bits = {}
        for own, _, keys, _ in parts:
            mask = bits.setdefault(own, np.zeros(1 << 22, bool))
            mask[(keys >> np.uint64(42)).astype(np.int64)] = True
        exact: dict[int, set[bytes]] = {}  # items that were candidates lately
        for b in slices(batches, 1, 2 << 20, 4096):
            w = _text_words(b.column(1))
            h = w.hashes()
            row = w.row
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for own, mask in bits.items():
                s = _hashes(h, own)
                at = np.flatnonzero(mask[(s >> np.uint64(42)).astype(np.int64)])
                if not len(at):
                    continue
                at = at[starts_of_windows(w.first, own, len(w))[at]]
                pairs = set()
                for _, _, keys, owner in (p for p in parts if p[0] == own):
                    lo, hi = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
                    pairs.update((int(row[at[i]]), int(owner[j])) for i in np.flatnonzero(hi > lo) for j in range(lo[i], hi[i]))
                have: dict[int, set[bytes]] = {}
                for r, item in sorted(pairs):
                    if r not in have:
                        have = {r: _shingles(w, r, own)}
                    if item not in exact:
                        if len(exact) > 4096:
                            exact.clear()
                        exact[item] = _shingles(_text_words(pa.array([texts[item]])), 0, own)
                    n, hit = len(exact[item]), len(exact[item] & have[r])
                    if hit >= threshold * n - 1e-9:
                        pair = r, int(ids[item])
                        best[pair] = max(best.get(pair, (0.0, 0, 0)), (hit / n, n, hit))
            out = [(b.column(0)[r].as_py(), item, n, hit, c) for (r, item), (c, n, hit) in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.float64(),))], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.7, block_chars: int = 8 << 20) -> DataFrame:
    """(document, item) pairs in which the document has at least ``threshold`` of the item's distinct ``k``-word shingles.

    Words are runs of letters and digits of the lower-cased text (ASCII marks and white space separate; other characters are
    word characters).  An item with fewer than k words is one shingle.  Items without words, null items and null documents match
    nothing.  Repeated documents are answered each; item texts that repeat under one id count once, and of different texts under
    one id each is searched and the best containment is reported.  Empty tables give nothing; other columns aren't looked at.

    The items are the stated query set.  They are taken in blocks of at most ``block_chars`` characters (the texts of one id, if
    longer, are a block of their own), so what is broadcast is bounded: a block's texts, and 16 bytes for each hash of its sketches.  A
    document's distinct shingles are searched for the sketches of each size partition; every block is searched in all
    documents, whole, in one pass without a shuffle."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    q = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    found, block, size = None, [], 0

    def search(block: list[tuple[int, str]]) -> DataFrame:
        texts = [t for _, t in block]
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), texts, index_items(texts, k, threshold)))
        return src.mapInArrow(_search(shared, k, threshold), _OUT)

    for r in q.orderBy("i", "t").toLocalIterator():  # a block at a time, never all items
        if block and size + len(r["t"]) > block_chars and r["i"] != block[-1][0]:
            part = search(block)
            found, block, size = part if found is None else found.unionByName(part), [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    part = search(block)
    return part if found is None else found.unionByName(part)


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM ik)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s, k FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k))
SELECT doc_id, item_id, n_shingles, count(*) AS n_matched, count(*) / CAST(n_shingles AS DOUBLE) AS containment
FROM dsh JOIN ish USING (s, k) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.7 * n_shingles - 1e-9"""
