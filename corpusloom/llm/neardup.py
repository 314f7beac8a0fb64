"""Near-duplicate groups: an inverted join on the coordinates of MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ._shared import buckets_for, by_bucket, written
from ._words import Words, from_planes, groups_of, mix, planes, rolling, six, slices, starts_of_windows, unsix

U = np.uint64
_ROW = U(53)
_ELEMENT = U((1 << 53) - 1)
#: Times that a list names a leader for the first links, and leaders kept for a node; they only save work, no link depends on them.
TURNS, LEADERS = 6, 3
#: Counters that a task keeps to find crowded coordinate-value pairs.
COUNTERS = 1 << 16
#: Most bits of the filter that tells which texts are wanted (8 MiB); what it lets through in vain is dropped by a join.
WANTED = 1 << 26
#: Nodes in a bucket of nodes, and bytes in other buckets.
NODES, BYTES = 8192, 12 << 20
_MSG = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_DDL = "bucket int, kind tinyint, a binary, b binary, c binary, d binary"
_POSTS = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("node", pa.binary()), ("n", pa.binary()), ("label", pa.binary()), ("sig", pa.binary())])
_PAIRS = "a long, b long"


def _sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 53-bit shingle hashes of each row (at most 2048 rows) and the rows' bounds."""
    w = Words(col, lower=True)
    h = w.hashes()
    at = np.flatnonzero(starts_of_windows(w.first, width, len(w)))
    key = (w.row[at].astype(U) << _ROW) | (rolling(h, width)[at] >> U(11))
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        whole = [xxhash.xxh3_64_intdigest(b" ".join(w.word(i) for i in range(w.first[r], w.first[r + 1])), 1) >> 11 for r in few]
        key = np.concatenate([key, (few.astype(U) << _ROW) | np.array(whole, U)])
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    first = np.searchsorted(key, np.arange(len(w.counts) + 1).astype(U) << _ROW)
    return key & _ELEMENT, first


def _class_of(elements: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each non-empty set: the sum of its mixed elements."""
    return np.add.reduceat(mix(elements, 11), begin).view(np.int64) if len(begin) else np.empty(0, np.int64)


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 63, k, dtype=np.int64).astype(U), rng.integers(0, 1 << 63, k, dtype=np.int64).astype(U) | U(1)


def _signatures(elements: np.ndarray, begin: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    x = mix(elements, 3)
    return np.stack([np.minimum.reduceat((x ^ f) * t, begin) >> U(32) for f, t in zip(flip, times)], axis=1).astype("<u4")


def _sketch(width: int, k: int):
    def run(batches):
        flip, times = _functions(k)
        for b in slices(batches, 1, 1 << 20, 1 << 11):
            e, first = _sets(b.column(1), width)
            n = np.diff(first)
            full = np.flatnonzero(n)
            cls, sig = np.zeros(len(n), np.int64), np.zeros((len(n), k), "<u4")
            if len(full):
                cls[full] = _class_of(e, first[:-1][full])
                sig[full] = _signatures(e, first[:-1][full], flip, times)
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * k), len(n), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(cls), sigs], names=["doc_id", "th", "n", "cls", "sig"])

    return run


def _matrix(col: pa.Array, kind: str, width: int) -> np.ndarray:
    """Equally long binary values as rows of a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty((0, width), kind)
    offs = np.frombuffer(col.buffers()[1], np.int32)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[col.offset] : offs[col.offset + len(col)]].view(kind).reshape(-1, width)


def matches_needed(k: int, threshold: float, miss: float = 1e-6) -> int:
    """The most coordinates that can be asked for so that a pair at the threshold is overlooked with probability ``miss`` at most."""
    below, t = 0.0, 0
    while t < k:
        below += math.exp(math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1) + t * math.log(threshold) + (k - t) * math.log1p(-threshold)) if threshold < 1 else 0.0
        if below > miss:
            break
        t += 1
    return max(1, t)


def _tokens(sig: np.ndarray) -> np.ndarray:
    return mix(sig.astype(U) | (np.arange(sig.shape[1]).astype(U) << U(32)), 5)


def _crowded_in_task(k: int):
    """Coordinate-value pairs that a task meets often, with counts that are never too high (Misra and Gries 1982)."""

    def run(batches):
        keys, counts = np.empty(0, U), np.empty(0, np.int64)
        for b in batches:
            u, c = np.unique(_tokens(_matrix(b.column(0), "<u4", k)), return_counts=True)
            both = np.concatenate([keys, u])
            keys, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, c])).astype(np.int64)
            if len(keys) > COUNTERS:
                counts -= np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        many = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], names=["token", "c"])

    return run


def _crowded(nodes: DataFrame, k: int, n: int) -> np.ndarray:
    """Coordinate-value pairs that too many nodes have to meet in one list: more than 65536, and a share of 1/16384 of all.

    There are at most k * 16384 of them at any input size, 8 MiB for k = 64."""
    most = max(1 << 16, n >> 14)
    if n <= most:
        return np.empty(0, U)
    rows = nodes.select("sig").mapInArrow(_crowded_in_task(k), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") > most // 2)
    return np.sort(np.array([r["token"] for r in rows.select("token").collect()], np.int64).view(U))


def _among(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of q are among the sorted keys?"""
    return keys[np.minimum(np.searchsorted(keys, q), len(keys) - 1)] == q if len(keys) else np.zeros(q.shape, bool)


def _rows_of(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MSG)], schema=_MSG) if out else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _MSG], schema=_MSG)


def _post_all(k: int, n_buckets: int, crowded):
    """Every node under each of its coordinate-value pairs (but the crowded ones)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                b = whole.slice(lo, 8192)
                tok = _tokens(_matrix(b.column(1), "<u4", k)).ravel()
                cls = b.column(0).to_numpy()
                at = np.flatnonzero(~_among(crowded.value, tok))
                order, which, bound = groups_of((((tok[at] >> U(32)) * U(n_buckets)) >> U(32)).astype(np.int64))
                out = []
                for w, x, y in zip(which, bound, bound[1:]):
                    i = at[order[x:y]]
                    row = i // k
                    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    out.append((int(w), 0, six(tok[i]), cls[row[cut]].astype("<i8").tobytes(), np.diff(np.append(cut, len(i))).astype(np.uint8).tobytes(), (i % k).astype(np.uint8).tobytes()))
                if out:
                    yield _rows_of(out)

    return run


def _collide(k: int, n_nodes: int):
    """How long is the list of each coordinate-value pair that more than one node has?  Answers go to the buckets of its nodes."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        tok = np.concatenate([unsix(x.as_py()) for x in t["a"]])
        per = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["c"]])
        cls = np.repeat(np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in t["b"]]), per)
        coord = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["d"]])
        del t, table
        order = np.argsort(tok)
        tok = tok[order]
        cut = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(cut, len(tok)))
        del tok
        cut, size, order = cut[size > 1], size[size > 1], order[np.repeat(size > 1, size)]
        if not len(order):
            return pa.Table.from_batches([_rows_of([])])
        cls, coord = cls[order], coord[order]
        code = np.where(size <= 200, size, np.minimum(254, 192 + np.ceil(np.log2(size)))).astype(np.uint8)
        out = []
        code = np.repeat(code, size)
        bucket = _node_bucket(cls, n_nodes)
        o = np.lexsort((cls, bucket))
        bucket, cls, coord, code = bucket[o], cls[o], coord[o], code[o]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for x, y in zip(edge, np.append(edge[1:], len(cls))):
            c = cls[x:y]
            new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            out.append((int(bucket[x]), 1, c[new].astype("<i8").tobytes(), np.diff(np.append(new, len(c))).astype(np.uint8).tobytes(), coord[x:y].tobytes(), code[x:y].tobytes()))
        return pa.Table.from_batches([_rows_of(out)])

    return run


def _node_bucket(cls: np.ndarray, n: int) -> np.ndarray:
    return (mix(cls.view(U), 61) % U(n)).astype(np.int64)


def _as_nodes(k: int, n_nodes: int):
    def run(batches):
        for b in batches:
            cls, n, sig = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), "<u4", k)
            order, which, bound = groups_of(_node_bucket(cls, n_nodes))
            out = []
            for w, x, y in zip(which, bound, bound[1:]):
                i = order[x:y]
                out.append((int(w), 3, cls[i].astype("<i8").tobytes(), planes(n[i], "<u4"), sig[i].tobytes(), b""))
            yield _rows_of(out)

    return run


def _as_labels(n_nodes: int):
    def run(batches):
        for b in batches:
            cls, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            order, which, bound = groups_of(_node_bucket(cls, n_nodes))
            out = []
            for w, x, y in zip(which, bound, bound[1:]):
                i = order[x:y]
                out.append((int(w), 4, cls[i].astype("<i8").tobytes(), root[i].astype("<i8").tobytes(), b"", b""))
            if out:
                yield _rows_of(out)

    return run


def _post(k: int, need: int, crowded, n_buckets: int, hot: int):
    """Nodes of a bucket under the coordinate-value pairs of their prefix: the k - need + 1 rarest, without those that no other node has.

    Two nodes that agree in ``need`` coordinates share a pair of their prefixes.  Under a pair that ``hot`` codes call crowded, a node
    is posted once for each later pair of its next-longer prefix instead: the two must share a second one there too."""
    prefix = k - need + 1

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        kind = t["kind"].to_numpy()
        got = lambda what, col, kind_: np.concatenate([kind_(t[col][int(i)].as_py()) for i in np.flatnonzero(kind == what)] or [kind_(b"")])
        long_, byte = (lambda x: np.frombuffer(x, "<i8")), (lambda x: np.frombuffer(x, np.uint8))
        node = got(3, "a", long_)
        if not len(node):
            return pa.Table.from_arrays([pa.array([], f.type) for f in _POSTS], schema=_POSTS)
        n, sig = got(3, "b", lambda x: from_planes(x, "<u4")), got(3, "c", lambda x: np.frombuffer(x, "<u4")).reshape(-1, k)
        order = np.argsort(node)
        node, n, sig = node[order], n[order], sig[order]
        label = node.copy()
        label[np.searchsorted(node, got(4, "a", long_))] = got(4, "b", long_)
        tok = _tokens(sig)
        code = np.ones(tok.shape, np.uint8)
        code[_among(crowded.value, tok)] = 255
        code[np.repeat(np.searchsorted(node, got(1, "a", long_)), got(1, "b", byte)), got(1, "c", byte)] = got(1, "d", byte)
        del t, table
        key = np.sort((code.astype(U) << U(56)) | (tok >> U(8)), axis=1)[:, : prefix + 1]
        del tok
        code = key[:, :prefix] >> U(56)
        row, col = np.nonzero((code > 1) & (code < hot))
        keys = key[row, col]
        hrow, hcol = np.nonzero(code >= hot)
        if len(hrow):
            more_k, more_r = [keys], [row]
            for j in range(1, key.shape[1]):
                m = hcol < j
                more_k.append(mix(key[hrow[m], hcol[m]] ^ mix(key[hrow[m], j], 21), 22)), more_r.append(hrow[m])
            keys, row = np.concatenate(more_k), np.concatenate(more_r)
        nib = mix(sig.astype(U), 31) >> U(60)
        packed = np.zeros((len(sig), -(-k // 16)), U)
        for c in range(k):
            packed[:, c // 16] |= nib[:, c] << U(4 * (c % 16))
        order, which, bound = groups_of((mix(keys, 41) % U(n_buckets)).astype(np.int64))
        out = []
        for w, x, y in zip(which, bound, bound[1:]):
            i = order[x:y]
            r = row[i]
            out.append((int(w), keys[i].tobytes(), node[r].tobytes(), planes(n[r], "<u4"), planes(label[r] ^ node[r], "<i8"), packed[r].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _POSTS)] if out else [pa.array([], f.type) for f in _POSTS], schema=_POSTS)

    return run


def _lists(t: pa.Table, words: int):
    """Key, node, set size, label and packed signature of the postings of a bucket."""
    cat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[name]])
    plain = lambda name, kind: np.concatenate([from_planes(x.as_py(), kind) for x in t[name]])
    node = cat("node", "<i8")
    return cat("key", "<u8"), node, plain("n", "<u4").astype(np.int64), plain("label", "<i8") ^ node, cat("sig", "<u8").reshape(-1, words)


def _agreements(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """In how many coordinates do packed signatures agree, by 4 bits of each?"""
    z = x ^ y
    z |= z >> U(1)
    z |= z >> U(2)
    return k - np.bitwise_count(z & U(0x1111111111111111)).sum(axis=1).astype(np.int64)


def _pair_counts(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    x = np.concatenate(a) if a else np.empty(0, np.int64)
    y = np.concatenate(b) if b else np.empty(0, np.int64)
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.empty(0, np.int64)
    return pa.table({"a": pa.array(x[new]), "b": pa.array(y[new]), "c": pa.array(np.diff(np.append(new, len(x))).astype(np.int64))})


def _lead(k: int, least: int, num: int, den: int):
    """Pairs (a, b) of a list's leader a, drawn by hash, and the nodes that agree with it in ``least`` coordinates; the rest of the list
    names the next leader.  A list of any length costs a pass for each turn."""
    words = -(-k // 16)

    def run(table: pa.Table) -> pa.Table:
        key, node, n, _, sig = _lists(table.combine_chunks(), words)
        order = np.lexsort((node, key))
        found_a, found_b = [], []
        for _ in range(TURNS):
            ks = key[order]
            cut = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if len(ks) else np.empty(0, np.int64)
            size = np.diff(np.append(cut, len(ks)))
            order = order[np.repeat(size > 1, size)]
            if not len(order):
                break
            size = size[size > 1]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            head = np.repeat(order[first], size)
            near = np.zeros(len(order), bool)
            for x in range(0, len(order), 1 << 16):
                i, j = head[x : x + (1 << 16)], order[x : x + (1 << 16)]
                near[x : x + (1 << 16)] = (_agreements(sig[i], sig[j], k) >= least) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
            m = near & (node[head] != node[order])
            found_a.append(node[head[m]]), found_b.append(node[order[m]])
            order = order[~near]  # a leader is near itself
        return _pair_counts(found_a, found_b)

    return run


def _skip_merge(k: int, need: int, num: int, den: int):
    """Pairs that share a list, differ in label, may be alike by size, and agree in ``need`` coordinates (by 4 bits of each).

    Lists are in order of set size, so a node stops at the first partner that is too large."""
    words = -(-k // 16)

    def run(table: pa.Table) -> pa.Table:
        key, node, n, label, sig = _lists(table.combine_chunks(), words)
        order = np.lexsort((n, key))
        ks = key[order]
        cut = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        size = np.diff(np.append(cut, len(ks)))
        lab = label[order]
        mixed = np.minimum.reduceat(lab, cut) != np.maximum.reduceat(lab, cut)
        keep = order[np.repeat(mixed & (size > 1), size)]
        key, node, n, label, sig = key[keep], node[keep], n[keep], label[keep], sig[keep]
        found_a, found_b = [], []
        i, step = np.arange(len(key)), 0
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            j = i + step
            go = (key[i] == key[j]) & (den * n[i] >= num * n[j])
            i, j = i[go], j[go]
            m = np.flatnonzero(label[i] != label[j])
            if len(m):
                m = m[_agreements(sig[i[m]], sig[j[m]], k) >= need]
                x, y = node[i[m]], node[j[m]]
                found_a.append(np.minimum(x, y)), found_b.append(np.maximum(x, y))
        return _pair_counts(found_a, found_b)

    return run


def id_filter(ids: DataFrame, id_col: str, count: int) -> tuple[Column, np.ndarray]:
    """The slot of an id, and packed bits of the slots that ``ids`` takes: 16 bits for each of ``count`` ids, 8 MiB at most."""
    n_bits = 1 << min(WANTED.bit_length() - 1, max(16, (16 * count).bit_length()))
    slot = F.pmod(F.xxhash64(id_col), F.lit(n_bits)).cast("long")
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in ids.select((slot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect():  # n_bits / 8 bytes in all
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    return slot, bits


def _is_in(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _by_filter(shared, at: int, there: bool):
    def run(batches):
        for b in batches:
            hit = _is_in(shared.value, b.column(at).fill_null(0).to_numpy()) & np.asarray(b.column(at).is_valid())
            yield b.filter(pa.array(hit == there))

    return run


def _squeeze(wanted):
    """Rows whose id the filter knows, their texts compressed."""

    def run(batches):
        bits, press = wanted.value, zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(_is_in(bits, b.column(3).to_numpy())))
            for x in slices(iter([b]), 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array([press.compress(t.as_buffer()) for t in x.column(1)], pa.binary())], names=["doc_id", "th", "z"])

    return run


def _judge(width: int, k: int, need: int, num: int, den: int):
    """Pairs of a bucket that agree in ``need`` coordinates and whose full sets are alike.  A text is unpacked once for all its pairs."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        is_text = np.asarray(t["z"].is_valid())
        own = t["a"].to_numpy()[is_text]
        flip, times = _functions(k)
        unpack = zstandard.ZstdDecompressor().decompress
        sets: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        z = t["z"].filter(pa.array(is_text)).combine_chunks()
        for lo in range(0, len(z), 64):
            raw = pa.RecordBatch.from_arrays([pa.array([unpack(x.as_buffer()) for x in z[lo : lo + 64]], pa.large_binary()).cast(pa.large_string())], names=["t"])
            for b in slices(iter([raw]), 0, 2 << 20, 1 << 11):
                e, first = _sets(b.column(0), width)
                sets += [e[x:y] for x, y in zip(first, first[1:])]
                sigs.append(_signatures(e, first[:-1], flip, times))
        order = np.argsort(own)
        sig = np.concatenate(sigs)[order] if sigs else np.empty((0, k), "<u4")
        a, b = t["a"].to_numpy()[~is_text], t["b"].filter(pa.array(~is_text)).to_numpy()
        i, j = np.searchsorted(own[order], a), np.searchsorted(own[order], b)
        near = np.zeros(len(a), bool)
        for x in range(0, len(a), 1 << 14):
            near[x : x + (1 << 14)] = (sig[i[x : x + (1 << 14)]] == sig[j[x : x + (1 << 14)]]).sum(axis=1) >= need
        a, b, i, j = a[near], b[near], order[i[near]], order[j[near]]
        by = np.argsort(i, kind="stable")
        a, b, i, j = a[by], b[by], i[by], j[by]
        ok = np.zeros(len(a), bool)
        cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
        for x, y in zip(cut, np.append(cut[1:], len(i))):
            one = sets[i[x]]
            for lo in range(x, y, 256):
                rest = [sets[p] for p in j[lo : min(y, lo + 256)]]
                size = np.array([len(r) for r in rest])
                both = np.add.reduceat(_among(one, np.concatenate(rest)).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
                ok[lo : lo + len(rest)] = den * both >= num * (len(one) + size - both)
        return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(b[ok], pa.int64())})

    return run


def _confirm(pairs: DataFrame, nodes: DataFrame, src: DataFrame, width: int, k: int, need: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links.

    A pair is judged in the bucket of its end with fewer pairs, so a text goes to its own bucket once, and to as many others as it has
    partners with fewer pairs there: once for each bucket, not for each pair.  Texts travel compressed and only where wanted."""
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("pairs"))
    ends = written(ends.join(nodes.select("cls", "n", "doc_id", "th"), "cls"), "ends")
    total = ends.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    n_buckets = buckets_for((total["n"] or 0) * 16, BYTES)
    degree = lambda c: ends.select(F.col("cls").alias(c), F.col("pairs").alias(f"p{c}"))
    at = F.pmod(F.xxhash64(F.when(F.struct("pa", "a") < F.struct("pb", "b"), F.col("a")).otherwise(F.col("b"))), F.lit(n_buckets)).cast("int").alias("bucket")
    routed = written(pairs.join(degree("a"), "a").join(degree("b"), "b").select(at, "a", "b"), "routed")
    goes = routed.select("bucket", F.col("a").alias("cls")).unionByName(routed.select("bucket", F.col("b").alias("cls"))).distinct().join(ends.select("cls", "doc_id", "th"), "cls")
    slot, bits = id_filter(ends, "doc_id", total["c"])
    texts = src.filter("doc_id is not null").select("doc_id", "text", "th", slot.alias("s")).mapInArrow(_squeeze(spark.sparkContext.broadcast(bits)), "doc_id long, th long, z binary")
    texts = texts.groupBy("doc_id", "th").agg(F.any_value("z").alias("z")).join(goes, ["doc_id", "th"])
    null = lambda kind: F.lit(None).cast(kind)
    met = texts.select("bucket", F.col("cls").alias("a"), null("long").alias("b"), "z").unionByName(routed.select("bucket", "a", "b", null("binary").alias("z")))
    return by_bucket(met, n_buckets).applyInArrow(_judge(width, k, need, num, den), _PAIRS)


def connected(edges: DataFrame) -> DataFrame:
    """node, root: nodes with an edge (a, b), and one node of their component, the same for all of it.

    Every round each node moves to the neighbour (or itself) that hashes lowest, which at least halves a component on
    average; edges follow and are made distinct.  A hub's edges are aggregated before they are shuffled."""
    e = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct(), "edges")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    steps = []
    while not e.isEmpty():
        low = e.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), F.col("m"))["x"].alias("to"))
        low = written(low, "moves")
        steps.append(low)
        moved = e.join(low, "u").select(F.col("to").alias("u2"), "v").join(low.select(F.col("u").alias("v"), F.col("to").alias("v2")), "v")
        e = written(moved.select(F.col("u2").alias("u"), F.col("v2").alias("v")).filter("u <> v").distinct(), "edges")
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for s in steps[1:]:
        out = out.join(s.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(out, "roots")


class _Index:
    """Nodes and their collisions under coordinate-value pairs, written."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, k: int):
        self.width, self.k, self.num, self.den, self.threshold = width, k, percent, 100, percent / 100
        self.need = matches_needed(k, self.threshold)
        text = F.col(f"`{text_col}`").cast("string")
        self.src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
        self.rows = written(self.src.mapInArrow(_sketch(width, k), "doc_id long, th long, n long, cls long, sig binary"), "sketches")
        nodes = self.rows.filter("n > 0 and doc_id is not null").groupBy("cls", "n").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.any_value("sig").alias("sig"))
        self.nodes = written(nodes.select("cls", "n", "m.doc_id", "m.th", "sig"), "nodes")
        self.count = self.nodes.count()
        self.node_buckets = max(8, -(-self.count // NODES))
        self.crowded = self.nodes.sparkSession.sparkContext.broadcast(_crowded(self.nodes, k, self.count))
        lists = buckets_for(self.count * k * 9, BYTES)
        posts = self.nodes.select("cls", "sig").mapInArrow(_post_all(k, lists, self.crowded), _DDL)
        self.collisions = written(by_bucket(posts, lists).applyInArrow(_collide(k, self.node_buckets), _DDL), "collisions")

    def _postings(self, labels: DataFrame | None, hot: int) -> GroupedData:
        k, need = self.k, self.need
        parts = self.collisions.unionByName(self.nodes.select("cls", "n", "sig").mapInArrow(_as_nodes(k, self.node_buckets), _DDL))
        if labels is not None:
            parts = parts.unionByName(labels.select("node", "root").mapInArrow(_as_labels(self.node_buckets), _DDL))
        n_buckets = buckets_for(self.count * (k - need + 1) * 50, BYTES)
        posts = by_bucket(parts, self.node_buckets).applyInArrow(_post(k, need, self.crowded, n_buckets, hot), "bucket int, key binary, node binary, n binary, label binary, sig binary")
        return by_bucket(posts, n_buckets)

    def likely(self, hot: int) -> DataFrame:
        """First links: of each node to the leaders that it meets in most lists."""
        least = max(self.need, math.ceil(0.95 * self.threshold * self.k))
        pairs = self._postings(None, hot).applyInArrow(_lead(self.k, least, self.num, self.den), _PAIRS + ", c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
        best = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), asc=False), 1, LEADERS).alias("h"))  # at most one for each posting of the node
        best = best.select("b", F.explode("h.a").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.confirm(written(best.distinct(), "likely"))

    def candidates(self, labels: DataFrame | None, hot: int) -> DataFrame:
        """Pairs (a < b) of nodes with different labels (node, root; without one a node's label is itself) above the match threshold."""
        pairs = self._postings(labels, hot).applyInArrow(_skip_merge(self.k, self.need, self.num, self.den), _PAIRS + ", c long")
        return written(pairs.select("a", "b").distinct(), "pairs")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        return written(_confirm(pairs, self.nodes, self.src, self.width, self.k, self.need, self.num, self.den), "links")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 2, k: int = 64, hot: int = 207) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts (A-Z lower-cased, split at ASCII white space) are sets of distinct ``width``-word shingles; fewer words are one
    shingle.  Sets are linked at ``percent`` of their union or more; a component is named by its smallest id.  Null, empty and
    blank texts have no shingles and are linked with nothing.  Equal sets are one node, so copies cost one row each.  Rows that share an
    id are judged each by their own text, and are kept or not by the id they share.  A row with a null id is linked with
    nothing, has a null component_id and is kept.  Of an empty table nothing comes back; other columns aren't looked at.

    Plan: nodes are posted under each coordinate-value pair of their signatures, and counting the lists gives the pairs' rarity.  Then
    nodes are posted under their rarest pairs only.  First each list's leaders meet the rest of it, so that a few links of each
    node are confirmed.  Then lists are merged in order of size, and pairs of different labels (what these links connect) that agree often enough are
    confirmed on full sets.  So a group of any size costs its links, not its pairs.  A pair at the threshold shares too few of the
    ``k`` coordinates with probability 1e-6 at most (``matches_needed``).
    """
    at = _Index(docs, id_col, text_col, percent, width, k)
    first = at.likely(hot)
    edges = first.unionByName(at.confirm(at.candidates(connected(first), hot)))
    roots = connected(edges)
    rows, reps = at.rows, at.nodes.select("cls", F.col("doc_id").alias("doc"))
    least = roots.join(reps.withColumnRenamed("cls", "node"), "node").groupBy("root").agg(F.min("doc").alias("component"))
    of = reps.join(roots.join(least, "root").select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", F.coalesce("component", "doc").alias("component"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(of, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that ``components`` keeps, with all their columns.

    Rows whose id a bounded filter doesn't know stay where they stand; only the rest, the dropped rows and a few others, meets the
    dropped ids in a join.  Null ids stay; of an empty table nothing comes back."""
    spark = docs.sparkSession
    gone = written(components(docs, id_col, text_col, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    slot, bits = id_filter(gone, "__gone", gone.count())
    shared = spark.sparkContext.broadcast(bits)
    own = F.col(f"`{id_col}`").cast("long")
    order = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*order, F.when(own.isNotNull(), F.pmod(F.xxhash64(own), F.lit(8 * len(bits)))).cast("long").alias("__slot"))
    at = len(docs.columns)
    clear = marked.mapInArrow(_by_filter(shared, at, False), marked.schema)
    doubtful = marked.mapInArrow(_by_filter(shared, at, True), marked.schema).join(gone, own == F.col("__gone"), "left_anti")
    return clear.unionByName(doubtful).select(*order)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 2, k: int = 64, hot: int = 207) -> tuple[DataFrame, DataFrame]:
    """Every link between different texts, and which texts there are: (class_a, class_b), (doc_id, class_id).

    A class is the documents with one set of shingles, named by its smallest id; members has a row for each row with a set and
    an id.  Links stand between classes (class_a < class_b), so copies aren't expanded.  The same join as in ``components``,
    without labels: a group of near copies costs all its links here."""
    at = _Index(docs, id_col, text_col, percent, width, k)
    found = at.confirm(at.candidates(None, hot))
    name = lambda c: at.nodes.select(F.col("cls").alias(c), F.col("doc_id").alias(f"d{c}"))
    pairs = found.join(name("a"), "a").join(name("b"), "b").select(F.least("da", "db").alias("class_a"), F.greatest("da", "db").alias("class_b"))
    members = at.rows.filter("n > 0 and doc_id is not null").select("doc_id", "cls").join(name("cls").withColumnRenamed("dcls", "class_id"), "cls").select("doc_id", "class_id")
    return pairs, members
