"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes counted in Spark."""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import buckets_for, by_bucket, text_bytes_of
from ._words import Words, from_planes, groups_of, mix, planes, rolling, slices, starts_of_windows

_NONE = -(1 << 63)
#: bucket; kind 0: window hashes or texts, 1: what the buckets answered, 2: positions of windows that repeat in their own slice, 3: the
#: hashes of these, once for each slice; payload.
_MSG = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_DDL = "bucket int, kind tinyint, a binary, b binary, c binary, d binary, e binary"


def _keys(batch: pa.RecordBatch, id_at: int, text_at: int) -> tuple[np.ndarray, np.ndarray]:
    """A row's key: its id and the CRC of its text.  Rows that agree in both are copies, with the same result."""
    ids = batch.column(id_at).cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)
    crc = np.array([zlib.crc32((t or "").encode()) for t in batch.column(text_at).to_pylist()], dtype=np.uint32)
    return ids, crc


def _doc_bucket(ids: np.ndarray, crc: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ (crc.astype(np.uint64) << np.uint64(20)), 77) % np.uint64(n)).astype(np.int64)


def _pack(ids, crc, first, pos) -> list[bytes]:
    """Keys of documents, entries per document, and positions as steps."""
    step = np.diff(pos, prepend=0)
    step[first[:-1]] = pos[first[:-1]]
    return [planes(ids, "<i8"), planes(crc, "<u4"), planes(np.diff(first), "<u4"), planes(step, "<u4")]


def _unpack(a, b, c, d):
    ids, crc, count, step = from_planes(a, "<i8"), from_planes(b, "<u4"), from_planes(c, "<u4").astype(np.int64), from_planes(d, "<u4").astype(np.int64)
    total = np.cumsum(step)
    first = np.concatenate([[0], np.cumsum(count)])
    before = np.where(first[:-1] > 0, total[first[:-1] - 1], 0)
    return ids, crc, count, total - np.repeat(before, count)


def _scatter(window: int, n_buckets: int):
    """Map side: hashes of all windows, one message for each slice and bucket.

    A window that repeats within the slice is known to be repeated: its positions pass through any bucket, and its hash goes to its
    own once, so that a window that stands everywhere costs its bucket one hash for each slice, not one for each occurrence."""

    def run(batches):
        for b in slices(batches, 1, 6 << 20, 65536):
            w = Words(b.column(1))
            h = rolling(w.hashes(), window)
            at = np.flatnonzero(starts_of_windows(w.first, window, len(w)))
            if not len(at):
                continue
            h, row, pos = h[at], w.row[at], at - w.first[w.row[at]]
            ids, crc = _keys(b, 0, 1)
            s = np.sort(h)
            many = np.unique(s[1:][s[1:] == s[:-1]])
            out = []

            def say(bucket: int, kind: int, hashes: bytes, mine: np.ndarray) -> None:
                r = row[mine]
                cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                d = r[cut]
                out.append((bucket, kind, hashes, *_pack(ids[d], crc[d], np.append(cut, len(r)), pos[mine])))  # noqa: B023

            once = np.arange(len(h))
            if len(many):
                here = many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h
                once, often = np.flatnonzero(~here), np.flatnonzero(here)
                say(int(s[len(s) // 2] % np.uint64(n_buckets)), 2, b"", often)
                order, which, bound = groups_of(_bucket_of(many, n_buckets))
                out += [(int(k), 3, many[order[lo:hi]].astype("<u8").tobytes(), b"", b"", b"", b"") for k, lo, hi in zip(which, bound, bound[1:])]
            order, which, bound = groups_of(_bucket_of(h[once], n_buckets))
            for k, lo, hi in zip(which, bound, bound[1:]):
                mine = once[order[lo:hi]]
                say(int(k), 0, h[mine].astype("<u8").tobytes(), mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MSG)], schema=_MSG)

    return run


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h, 0x5151) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _repeated(n_docs: int):
    """Bucket side: a window counts as repeated if its hash occurs twice in the bucket or repeats in a slice."""

    def run(table: pa.Table) -> pa.Table:
        msgs = table.combine_chunks()
        kind = msgs["kind"].to_numpy()
        single = [int(i) for i in np.flatnonzero(kind == 0)]
        hs = [np.frombuffer(msgs["a"][i].as_py(), "<u8") for i in single]
        often = [np.frombuffer(msgs["a"][int(i)].as_py(), "<u8") for i in np.flatnonzero(kind == 3)]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in hs])]).astype(np.int64)
        h = np.concatenate([np.empty(0, np.uint64), *hs])
        del hs
        s = np.sort(h)
        twice = np.unique(np.concatenate([s[1:][s[1:] == s[:-1]], *often]))
        del s, often
        near = np.searchsorted(twice, h)
        hit = (twice[np.minimum(near, len(twice) - 1)] == h) if len(twice) else np.zeros(len(h), bool)
        del h, near
        ids, crc, pos = [], [], []
        for i, lo, hi in zip(single, edge, edge[1:]):
            mine = hit[lo:hi]
            if mine.any():
                di, dc, count, p = _unpack(*(msgs[x][i].as_py() for x in "bcde"))
                row = np.repeat(np.arange(len(di)), count)[mine]
                ids.append(di[row]), crc.append(dc[row]), pos.append(p[mine])
        for i in np.flatnonzero(kind == 2):
            di, dc, count, p = _unpack(*(msgs[x][int(i)].as_py() for x in "bcde"))
            ids.append(np.repeat(di, count)), crc.append(np.repeat(dc, count)), pos.append(p)
        if not ids:
            return _MSG.empty_table()
        ids, crc, pos = np.concatenate(ids), np.concatenate(crc), np.concatenate(pos)
        order = np.lexsort((pos, crc, ids, _doc_bucket(ids, crc, n_docs)))
        ids, crc, pos = ids[order], crc[order], pos[order]
        bucket = _doc_bucket(ids, crc, n_docs)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out = []
        for lo, hi in zip(cut, np.append(cut[1:], len(ids))):
            i, c, p = ids[lo:hi], crc[lo:hi], pos[lo:hi]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (c[1:] != c[:-1])]))
            out.append((int(bucket[lo]), 1, b"", *_pack(i[new], c[new], np.append(new, len(i)), p)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MSG)], schema=_MSG)

    return run


def _texts(n_docs: int):
    """Whole rows, compressed, to the bucket of their key."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 1, 8 << 20, 65536):
            ids, crc = _keys(b, 0, 1)
            order, which, bound = groups_of(_doc_bucket(ids, crc, n_docs))
            out = []
            for k, lo, hi in zip(which, bound, bound[1:]):
                mine = order[lo:hi]
                sink = pa.BufferOutputStream()
                part = b.take(pa.array(mine))
                with pa.ipc.new_stream(sink, part.schema) as to:
                    to.write_batch(part)
                out.append((int(k), 0, press.compress(sink.getvalue()), planes(ids[mine], "<i8"), planes(crc[mine], "<u4"), b"", b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MSG)], schema=_MSG)

    return run


def _merge(window: int, schema: pa.Schema):
    """Merge each document's repeated windows into maximal intervals and take the words in them out."""

    def run(table: pa.Table) -> pa.Table:
        msgs = table.combine_chunks()
        kind = msgs["kind"].to_numpy()
        got = [_unpack(*(msgs[x][int(i)].as_py() for x in "bcde")) for i in np.flatnonzero(kind == 1)]
        where: dict[tuple[int, int], np.ndarray] = {}
        if got:
            ids = np.concatenate([np.repeat(g[0], g[2]) for g in got])
            crc = np.concatenate([np.repeat(g[1], g[2]) for g in got])
            pos = np.concatenate([g[3] for g in got])
            order = np.lexsort((pos, crc, ids))
            ids, crc, pos = ids[order], crc[order], pos[order]
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (crc[1:] != crc[:-1])]))
            where = {(int(ids[lo]), int(crc[lo])): pos[lo:hi] for lo, hi in zip(cut, np.append(cut[1:], len(ids)))}
        out = []
        for i in np.flatnonzero(kind == 0):
            raw = zstandard.ZstdDecompressor().decompress(msgs["a"][int(i)].as_py())
            rows = pa.ipc.open_stream(raw).read_all().combine_chunks()
            ids, crc = from_planes(msgs["b"][int(i)].as_py(), "<i8"), from_planes(msgs["c"][int(i)].as_py(), "<u4")
            n_words, n_removed, spans, kept = [], [], [], []
            for d, c, text in zip(ids, crc, rows.column(1).to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                starts = where.get((int(d), int(c)))
                if starts is None:
                    spans.append([]), n_removed.append(0), kept.append(b" ".join(words))
                    continue
                new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
                lo, hi = starts[new], np.append(starts[new[1:] - 1], starts[-1]) + window
                keep = np.ones(len(words), bool)
                for x, y in zip(lo, hi):
                    keep[x:y] = False
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(lo, hi)])
                n_removed.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(compress(words, keep)))
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            texts = pa.array([x.decode() for x in kept], pa.string())
            arrays = [*(rows.column(k) for k in range(rows.num_columns)), *new, texts, pa.array(spans, schema.field("removed").type)]
            out.append(pa.Table.from_arrays([a.cast(f.type) for a, f in zip((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays), schema)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts anywhere else in the table.

    Returns all columns of ``docs`` and: n_words, n_removed, kept_sha256, kept_text (kept words joined by one space),
    removed (maximal intervals of word positions, start inclusive, stop exclusive).  Windows are judged on the input.
    Null and empty texts have no words and an empty kept_text; texts shorter than a window keep all; repeated rows
    (even with one id) are documents of their own, so a window in both is repeated; a null id is a key like any other.
    A column of ``docs`` with one of the new names is replaced.

    Plan: all windows' 64-bit hashes go once, in packed messages, to the bucket that a second hash names (so 64 bits
    and the bucket's must agree before two windows are taken as one); windows that repeat within a slice of texts are combined there, so no
    bucket gets more than one hash of a window for each slice; it answers only with repeated positions.  Texts go once, compressed, to meet them.
    """
    new = ("n_words", "n_removed", "kept_sha256", "kept_text", "removed")
    rest = [c for c in docs.columns if c not in (id_col, text_col, *new)]
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in rest])
    keys = src.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    size = text_bytes_of(keys, "t")
    n_buckets, n_docs = buckets_for(size * 2), buckets_for(size)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", span)]
    result = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in src.schema.fields], *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(result)
    answers = keys.mapInArrow(_scatter(window, n_buckets), _DDL)
    answers = by_bucket(answers, n_buckets).applyInArrow(_repeated(n_docs), _DDL)
    texts = src.mapInArrow(_texts(n_docs), _DDL)
    return by_bucket(texts.unionByName(answers), n_docs).applyInArrow(_merge(window, arrow), result)
