"""Packing by shortest-pack-first over the histogram of lengths (Krell et al. 2021)."""

from __future__ import annotations

import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import text_bytes_of, written
from ._words import hash_spans, slices, text_bytes

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long"


class _Encoder:
    """Ids of the named tokenizer, each distinct unit encoded once per worker.

    A unit runs from a single space that follows a non-space byte to the next such space.  The pre-tokenizer never joins
    anything across that point, so the ids of a text are those of its units in order."""

    LIMIT = 1_200_000  # units kept from slice to slice; more are encoded again each time
    JOINED = 10  # units to a call's text

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # a special token's name in a text is ordinary text
        vocab = self.tok.get_vocab()
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # a byte-level token has a character for each byte
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.keys = np.empty(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint16)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def _encode(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has; those of ``joins`` may stand after each other, which costs less than a call for each.

        Such units are encoded ``JOINED`` at a time, and the widths of the ids tell where each unit's end.  If they don't meet the
        units' ends, the vocabulary isn't one of bytes, and every unit is encoded by itself."""
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        m = int(joins.sum())
        data, bounds = _ragged(buf, start[order], length[order])
        data = data.tobytes()
        groups = np.concatenate([np.arange(0, m, self.JOINED), np.arange(m, len(order) + 1)])
        at = bounds[groups].tolist()
        flat, n = self._ids([data[s:e].decode() for s, e in zip(at, at[1:])])
        ends = np.concatenate([[0], np.cumsum(self.width[flat])])
        cut = np.minimum(np.searchsorted(ends, bounds), len(flat))
        if not (ends[cut] == bounds).all() or not (cut[groups] == np.concatenate([[0], np.cumsum(n)])).all():
            at = bounds.tolist()
            flat, n = self._ids([data[s:e].decode() for s, e in zip(at, at[1:])])
            cut = np.concatenate([[0], np.cumsum(n)])
        begin, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], size[order] = cut[:-1], np.diff(cut)
        flat = _ragged(flat, begin, size)[0]
        return flat.astype(np.uint16) if not len(flat) or flat.max() < 65536 else flat, size

    def _add(self, keys: np.ndarray, flat: np.ndarray, n: np.ndarray):
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        old = np.diff(self.at)
        size = np.concatenate([old, n])
        begin = np.concatenate([self.at[:-1], len(self.ids) + np.concatenate([[0], np.cumsum(n)[:-1]])])
        pool = np.concatenate([self.ids, flat])
        return np.concatenate([self.keys, keys])[order], *_ragged(pool, begin[order], size[order])

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's bounds."""
        buf, off = text_bytes(col)
        n = len(buf)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        space = buf == 32
        # a cut is safe after a byte that is no white space of any kind; bytes of longer characters count as unsafe unless letters
        plain = (buf > 32) & (buf < 127) | (buf == 0xC3) | (buf >= 0x80)
        plain &= ~_wide_space(buf)
        cut = np.zeros(n, bool)
        cut[1:] = space[1:] & plain[:-1]
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, n))
        h = hash_spans(buf, start, length)
        u, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, u)
        known = (self.keys[np.minimum(near, len(self.keys) - 1)] == u) if len(self.keys) else np.zeros(len(u), bool)
        keys, at, ids = self.keys, self.at, self.ids
        if not known.all():
            new = where[~known]
            flat, size = self._encode(buf, start[new], length[new], space[start[new]] & plain[start[new] + length[new] - 1])
            keys, ids, at = self._add(u[~known], flat, size)
            if len(keys) <= self.LIMIT:
                self.keys, self.at, self.ids = keys, at, ids
        slot = np.searchsorted(keys, u)[inverse]
        flat, bounds = _ragged(ids, at[slot], np.diff(at)[slot])
        return flat, bounds[np.searchsorted(start, off)]


def _wide_space(buf: np.ndarray) -> np.ndarray:
    """Last bytes of characters of two and three bytes that may be white space (U+0085, U+00A0, U+1680, U+2000.., U+3000)."""
    out = np.zeros(len(buf), bool)
    out[1:] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0))
    out[2:] |= (buf[:-2] == 0xE1) & (buf[1:-1] == 0x9A) | (buf[:-2] == 0xE2) & ((buf[1:-1] == 0x80) | (buf[1:-1] == 0x81)) | (buf[:-2] == 0xE3) & (buf[1:-1] == 0x80)
    return out


def _ragged(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _pieces(path: str, room: int, end_id: int, n_buckets: int):
    """Tokenise whole texts, append the end id, cut every ``room`` ids."""

    def run(batches):
        encode = _Encoder(path)
        for b in slices(batches, 1, 4 << 20, 4096):
            flat, bounds = encode(b.column(1))
            out = []
            for d, lo, hi in zip(b.column(0).to_pylist(), bounds, bounds[1:]):
                ids = np.append(flat[lo:hi], end_id).astype("<u4")
                for s in range(0, len(ids), room):
                    piece = ids[s : s + room]
                    out.append((d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), ((d or 0) * 0x9E3779B97F4A7C15 >> 40) % n_buckets))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"])

    return run


def spfhp(histogram: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest pack first, longest lengths first, on counts: [(how many packs, their lengths in order)].

    A pattern is a kind of pack with a count.  All pieces of a length are placed before the next shorter length, each into the
    emptiest pattern that still has room (the shortest pack); what finds none opens new packs.  Each step uses up a pattern's
    count or the length's, so the steps are bounded by room squared, whatever the number of documents."""
    open_: list[tuple[int, int, int, tuple[int, ...]]] = []  # filled, tie, count, lengths
    done, tie = [], 0
    for length in sorted((k for k, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= room:
                filled, _, count, parts = heapq.heappop(open_)
            else:
                filled, parts, count = 0, (), left
                if not open_ or open_[0][0] + length > room:
                    # no open pack has room for this length; a new pack holds as many of it as fit
                    per = room // length
                    whole, rest = divmod(left, per)
                    for n, k in ((whole, per), (1 if rest else 0, rest)):
                        if n:
                            tie += 1
                            heapq.heappush(open_, (k * length, tie, n, (length,) * k))
                    left = 0
                    continue
            use = min(left, count)
            if count > use:
                tie += 1
                heapq.heappush(open_, (filled, tie, count - use, parts))
            left -= use
            tie += 1
            pack = (filled + length, tie, use, parts + (length,))
            if pack[0] == room:
                done.append((use, pack[3]))
            else:
                heapq.heappush(open_, pack)
    return done + [(c, parts) for _, _, c, parts in sorted(open_)]


def _slots(packs: list[tuple[int, tuple[int, ...]]]) -> tuple[dict, int]:
    """For each length the bounds of ranks, and the first sequence and the offset that each run of ranks goes to."""
    slots: dict[int, list[list[int]]] = {}
    base = 0
    for count, parts in packs:
        at = 0
        for length in parts:
            s = slots.setdefault(length, [[0], [], []])
            s[0].append(s[0][-1] + count), s[1].append(base), s[2].append(at)
            at += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in v) for k, v in slots.items()}, base


def _place(slots: dict):
    def run(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                m = np.flatnonzero(length == k)
                bounds, base, at = slots[int(k)]
                i = np.searchsorted(bounds, rank[m], "right") - 1
                seq[m], off[m] = base[i] + rank[m] - bounds[i], at[i]
            cols = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack every document's ids (and ``end_id``) into sequences of at most ``room`` tokens.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Longer documents are cut every
    ``room`` ids.  Null and empty texts are the end id alone; repeated rows and null ids are documents of their own.

    Plan: one pass tokenises and writes the piece table (numbers only); the histogram has at most ``room`` rows, and the
    patterns made from it are what the workers get.  A piece's rank among its length is its rank in (length, bucket) plus the
    counts of earlier buckets, so no length, however common, meets in one task.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_buckets = max(8, text_bytes_of(src, "text") // (4 << 20))
    pieces = written(src.mapInArrow(_pieces(tokenizer, room, end_id, n_buckets), _PIECES), "pieces")
    counts = pieces.groupBy("length", "bucket").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = written(counts.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `room` rows
    slots, _ = _slots(spfhp(histogram, room))
    local = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("local", local).join(counts.drop("count"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local") - 1)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(slots), schema)
