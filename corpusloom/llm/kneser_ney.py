"""Interpolated modified Kneser-Ney language model (Chen and Goodman 1999) of word pairs, in memory-mapped sorted hash arrays.

p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) * q(w), where q is the same formula over continuation counts (how many different
words stand before w), interpolated with the uniform distribution over the known types and one unknown type."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import buckets_for, by_bucket, local_path, text_bytes_of
from ._words import Words, from_planes, groups_of, mix, per_row, planes, slices

U = np.uint64
BEGIN, END = U(0xB36120D5E8F1C3A7), U(0xE4D0A9C15B72F683)
_MSG = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_DDL = "bucket int, kind tinyint, a binary, b binary, c binary, d binary"
_OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for all of them.  Small: at most a few hundred crowded contexts."""

    path: str
    shards: int
    tokens: int = 0  #: training tokens, ends included
    types: int = 0  #: distinct training tokens
    texts: int = 0
    pairs: int = 0  #: distinct pairs
    d2: tuple = (0.5, 1.0, 1.5)
    d1: tuple = (0.5, 1.0, 1.5)
    cont_stats: tuple = (0, 0, 0)
    crowded: np.ndarray = field(default_factory=lambda: np.empty((0, 2), U))  #: contexts and the salts of each, less one
    saved: frozenset = frozenset()  #: folders that the workers must find
    crowded_stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))


def stream(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of predicted tokens (a text's words, then one end) and of their contexts, and the rows' bounds."""
    w = Words(col, lower=True)
    rows = len(w.counts)
    first = w.first + np.arange(rows + 1)
    seen = np.empty(len(w) + rows, U)
    seen[np.arange(len(w)) + w.row] = w.hashes()
    seen[first[1:] - 1] = END
    context = np.empty_like(seen)
    context[1:] = seen[:-1]
    context[first[:-1]] = BEGIN
    return seen, context, first


def pair_id(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context ^ (word * U(0x9E3779B97F4A7C15)), 9)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more from how many have a count of 1 to 4; fixed where a count of counts is missing."""
    n1, n2, n3, n4 = n
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _take_off(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _shard(key: np.ndarray, n: int) -> np.ndarray:
    """Monotone in the key, so that sorted keys are in order of shards."""
    return ((key >> U(32)) * U(n)) >> U(32)


def _spread(context: np.ndarray, word: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """What a pair is sharded by: its context, and for crowded contexts its word too, in as many parts as the context has salts."""
    key = context.copy()
    if len(crowded):
        where = np.minimum(np.searchsorted(crowded[:, 0], context), len(crowded) - 1)
        at = np.flatnonzero(crowded[where, 0] == context)
        key[at] = mix(context[at] + (word[at] & crowded[where[at], 1]) + U(1), 13)
    return key


def _frequent(share: int):
    def run(batches):
        for b in slices(batches, 0, 4 << 20, 1 << 16):
            _, context, _ = stream(b.column(0))
            u, n = np.unique(context, return_counts=True)
            m = n * share > len(context)
            yield pa.RecordBatch.from_arrays([pa.array(mix(u[m], 1).view(np.int64)), pa.array(n[m].astype(np.int64)), pa.array(np.full(int(m.sum()), len(context), np.int64))], names=["c", "n", "of"])

    return run


def _crowded(src: DataFrame, shards: int) -> np.ndarray:
    """Contexts that may fill a fourth of a shard, at most some multiples of the number of shards; and the salts of each, less one: a power of
    two that follows the context's share, so that a part of it fills an eighth of a shard at most."""
    share = 8 * shards
    rows = src.mapInArrow(_frequent(share), "c long, n long, of long").groupBy("c").agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    found = rows.filter(F.col("n") * (4 * shards) > total).collect()
    c = np.array([r["c"] for r in found], np.int64).view(U)
    salts = np.array([(1 << max(4, (8 * shards * r["n"] // total).bit_length())) - 1 for r in found], U)
    return np.stack([c, salts], axis=1)[np.argsort(c)] if len(c) else np.empty((0, 2), U)


def _count(shards: int, crowded: np.ndarray):
    """Map side: the distinct pairs of a slice, by shard and context."""

    def run(batches):
        for b in slices(batches, 0, 12 << 20, 1 << 20):
            seen, context, _ = stream(b.column(0))
            _, at, n = np.unique(pair_id(context, seen), return_index=True, return_counts=True)
            context, word = mix(context[at], 1), seen[at] >> U(16)
            key = _spread(context, word, crowded)
            order = np.argsort(key)
            key, context, word, n = key[order], context[order], word[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(cut, len(key)))
            shard = _shard(key[cut], shards).astype(np.int64)
            edge = np.searchsorted(shard, np.arange(shards + 1))
            at = np.append(cut, len(key))
            out = []
            for s in np.flatnonzero(np.diff(edge)):
                x, y = edge[s], edge[s + 1]
                i, j = at[x], at[y]
                six = np.ascontiguousarray(word[i:j].view(np.uint8).reshape(-1, 8)[:, :6])
                out.append((int(s), 0, context[cut[x:y]].tobytes(), planes(size[x:y], "<u4"), six.tobytes(), planes(n[i:j], "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MSG)], schema=_MSG)

    return run


def _six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _save(path: str, **arrays: np.ndarray) -> None:
    """Each array to a file of its own; a repeated task replaces it with the same bytes."""
    os.makedirs(path, exist_ok=True)
    for name, a in arrays.items():
        part = os.path.join(path, f".{name}.{os.getpid()}.{os.urandom(4).hex()}")
        with open(part, "wb") as to:
            to.write(np.ascontiguousarray(a).tobytes())
        os.replace(part, os.path.join(path, name))


def _pairs(path: str, shards: int, crowded: np.ndarray):
    """A shard's counts and context sums to files; continuation counts go on to the shards of their words."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        s = t["bucket"][0].as_py()
        context, word, n = [], [], []
        for a, b, c, d in zip(t["a"], t["b"], t["c"], t["d"]):
            context.append(np.repeat(np.frombuffer(a.as_py(), "<u8"), from_planes(b.as_py(), "<u4")))
            word.append(_six(c.as_py()))
            n.append(from_planes(d.as_py(), "<u4").astype(np.int64))
        context, word, n = np.concatenate(context), np.concatenate(word), np.concatenate(n)
        del t, table
        order = np.lexsort((word, context))
        context, word, n = context[order], word[order], n[order]
        del order
        new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
        context, word, n = context[new], word[new], np.add.reduceat(n, new)
        counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        cut = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = np.stack([np.add.reduceat(x.astype(np.int64), cut) for x in (n, n == 1, n == 2, n > 2)], axis=1)
        own = context[cut]
        much = np.isin(own, crowded[:, 0])
        key = mix(context ^ (word * U(0xD1B54A32D192ED03)), 17)
        order = np.argsort(key)
        key, n = key[order], n[order]
        big = np.flatnonzero(n > 254)
        _save(os.path.join(path, f"pairs-{s}"), key=key, count=np.minimum(n, 255).astype(np.uint8), big_at=big, big=n[big])
        _save(os.path.join(path, f"contexts-{s}"), key=own[~much], sums=sums[~much].astype("<u4"))
        totals = np.array([*counts, int((~much).sum()), len(n)], np.int64)
        rows = [(s % shards, 2, own[much].tobytes(), sums[much].tobytes(), totals.tobytes(), str(s).encode())]
        w, c = np.unique(word, return_counts=True)
        order, which, bound = groups_of(_shard(mix(w, 4), shards).astype(np.int64))
        for k, x, y in zip(which, bound, bound[1:]):
            i = order[x:y]
            rows.append((int(k), 1, np.ascontiguousarray(w[i].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), planes(c[i], "<u4"), b"", b""))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MSG)], schema=_MSG)

    return run


def _words(path: str):
    """A shard's continuation counts to a file; sums go on to the driver."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        kind, s = t["kind"].to_numpy(), t["bucket"][0].as_py()
        at = [int(i) for i in np.flatnonzero(kind == 1)]
        rows = [tuple(t[x][int(i)].as_py() for x in _MSG.names) for i in np.flatnonzero(kind == 2)]
        if at:
            w = np.concatenate([_six(t["a"][i].as_py()) for i in at])
            c = np.concatenate([from_planes(t["b"][i].as_py(), "<u4").astype(np.int64) for i in at])
            order = np.argsort(w)
            w, c = w[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            w, c = w[new], np.add.reduceat(c, new)
            _save(os.path.join(path, f"words-{s}"), key=w, count=c.astype("<u4"))
            sums = [*np.bincount(np.minimum(c, 5), minlength=6)[1:5], int((c > 2).sum()), len(c), int(c.sum())]
            rows.append((s, 3, np.array(sums, np.int64).tobytes(), b"", b"", str(s).encode()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MSG)], schema=_MSG)

    return run


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = 24 << 20) -> Model:
    """Count all texts (A-Z lower-cased, words split at ASCII white space, one end each; null: an empty text) and store the model.

    Plan: a slice's distinct pairs go to the shard of their context, six bytes a word; contexts that would crowd a shard are
    spread by word too.  A shard sorts its pairs and writes them with its context sums; continuation counts, summed there, go to
    the shards of their words.  The driver gets a few sums per shard.  Files are replaced whole, so a task may run twice.  No rows
    give a model of nothing; repeated rows count each; ``shard_bytes`` decides no count, only how many shards there are."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    shards = buckets_for(text_bytes_of(src, "text"), shard_bytes)
    path = local_path(spark, "kneser-ney")
    crowded = _crowded(src, shards)
    counted = by_bucket(src.mapInArrow(_count(shards, crowded), _DDL), shards).applyInArrow(_pairs(path, shards, crowded), _DDL)
    rows = by_bucket(counted, shards).applyInArrow(_words(path), _DDL).collect()
    m = Model(path, shards, crowded=crowded, crowded_stats=np.zeros((len(crowded), 4), np.int64))
    n2, n1, own, over2 = np.zeros(4, np.int64), np.zeros(4, np.int64), 0, 0
    m.saved = frozenset(f"{what}-{r['d'].decode()}" for r in rows for what in (("pairs", "contexts") if r["kind"] == 2 else ("words",)))
    for r in rows:
        if r["kind"] == 2:
            at = np.searchsorted(crowded[:, 0], np.frombuffer(r["a"], U))
            np.add.at(m.crowded_stats, at, np.frombuffer(r["b"], np.int64).reshape(-1, 4))
            x = np.frombuffer(r["c"], np.int64)
            n2, own, m.pairs = n2 + x[:4], own + int(x[4]), m.pairs + int(x[5])
        else:
            x = np.frombuffer(r["a"], np.int64)
            n1, over2, m.types = n1 + x[:4], over2 + int(x[4]), m.types + int(x[5])
    m.d2, m.d1 = discounts([int(x) for x in n2]), discounts([int(x) for x in n1])
    m.cont_stats = (int(n1[0]), int(n1[1]), over2)
    if m.pairs:
        got = _Arrays(m).contexts(mix(np.array([BEGIN]), 1))
        m.texts = int(got[0, 0])
        total = src.mapInArrow(_tokens, "n long").agg(F.sum("n")).first()[0]
        m.tokens = int(total)
    return m


def _tokens(batches):
    for b in slices(batches, 0, 4 << 20, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array([len(Words(b.column(0))) + b.num_rows], pa.int64())], names=["n"])


class _Arrays:
    """The model's files, mapped when first asked for."""

    def __init__(self, m: Model):
        self.m, self.maps = m, {}

    def _map(self, folder: str, name: str, kind: str) -> np.ndarray:
        key = folder, name
        if key not in self.maps:
            at = os.path.join(self.m.path, folder, name)
            there = folder in self.m.saved and os.path.getsize(at)  # raises where the folder isn't mounted or a shard is lost
            self.maps[key] = np.memmap(at, kind, "r") if there else np.empty(0, kind)
        return self.maps[key]

    def _find(self, folder: str, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self._map(folder, "key", "<u8")
        if not len(keys):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        return at, keys[at] == q

    def contexts(self, c: np.ndarray) -> np.ndarray:
        """total, and followers seen once, twice and more, of sorted context keys; zeros if unseen."""
        out = np.zeros((len(c), 4), np.int64)
        edge = np.searchsorted(_shard(c, self.m.shards), np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(edge)):
            at, hit = self._find(f"contexts-{s}", c[edge[s] : edge[s + 1]])
            if hit.any():
                out[edge[s] : edge[s + 1]][hit] = self._map(f"contexts-{s}", "sums", "<u4").reshape(-1, 4)[at[hit]]
        if len(self.m.crowded):
            at = np.minimum(np.searchsorted(self.m.crowded[:, 0], c), len(self.m.crowded) - 1)
            hit = self.m.crowded[at, 0] == c
            out[hit] = self.m.crowded_stats[at[hit]]
        return out

    def words(self, w: np.ndarray) -> np.ndarray:
        """Continuation counts."""
        out = np.zeros(len(w), np.int64)
        order, which, bound = groups_of(_shard(mix(w, 4), self.m.shards).astype(np.int64))
        for s, x, y in zip(which, bound, bound[1:]):
            i = order[x:y]
            at, hit = self._find(f"words-{s}", w[i])
            if hit.any():
                out[i[hit]] = self._map(f"words-{s}", "count", "<u4")[at[hit]]
        return out

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        key = mix(context ^ (word * U(0xD1B54A32D192ED03)), 17)
        order, which, bound = groups_of(_shard(_spread(context, word, self.m.crowded), self.m.shards).astype(np.int64))
        for s, x, y in zip(which, bound, bound[1:]):
            i = order[x:y]
            i = i[np.argsort(key[i])]
            at, hit = self._find(f"pairs-{s}", key[i])
            if hit.any():
                n = self._map(f"pairs-{s}", "count", "u1")[at[hit]].astype(np.int64)
                many = np.flatnonzero(n == 255)
                if len(many):
                    n[many] = self._map(f"pairs-{s}", "big", "<i8")[np.searchsorted(self._map(f"pairs-{s}", "big_at", "<i8"), at[hit][many])]
                out[i[hit]] = n
        return out


def _score(m: Model):
    def run(batches):
        arrays = _Arrays(m)
        g1 = sum(a * b for a, b in zip(m.d1, m.cont_stats))
        for b in slices(batches, 1, 8 << 20, 1 << 20):
            seen, context, first = stream(b.column(1))
            key = mix(seen, 1)
            u, at, slot = np.unique(key, return_index=True, return_inverse=True)
            word = seen[at]
            sums = arrays.contexts(u)
            cont = arrays.words(word >> U(16))
            low = ((cont - _take_off(cont, m.d1)) + g1 / (m.types + 1)) / m.pairs if m.pairs else np.ones(len(u))
            c = sums[:, 0].copy()
            c[word == END] = m.texts
            total = np.append(sums[:, 0], m.texts)
            begin = arrays.contexts(mix(np.array([BEGIN]), 1))
            back = np.append(sums, begin, axis=0)[:, 1:] @ np.array(m.d2)
            before = np.empty(len(seen), np.int64)
            before[1:] = slot[:-1]
            before[first[:-1]] = len(u)
            p, at, again = np.unique(pair_id(context, seen), return_index=True, return_inverse=True)
            n = arrays.pairs(mix(context[at], 1), seen[at] >> U(16))
            t, q = total[before[at]], low[slot[at]]
            prob = np.where(t > 0, ((n - _take_off(n, m.d2)) + back[before[at]] * q) / np.maximum(t, 1), q)
            base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(np.diff(first)), pa.array(per_row((c > 0)[slot].astype(np.int64), first)), pa.array(np.full(rows, m.tokens)), pa.array(per_row(base[slot], first)), pa.array(per_row(np.log10(prob)[again], first))],
                names=["doc_id", *b.schema.names[2:], *[x.split()[0] for x in _OUT.split(", ")[1:]]],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", along: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens (words and one end), n_known, train_tokens, base_score, score (log10 probability of the whole text).

    base_score is that of single tokens with 0.1 added to each count.  Null and empty texts are an end alone; repeated rows are
    scored alike; a model of no text gives every text probability 1; a worker that can't see the model's files raises.  One pass without a shuffle; workers map the model's files,
    so their memory doesn't grow with the model.  Perplexity is 10 ** (-score / n_tokens).  Columns named by ``along`` come along, as strings,
    after doc_id."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").cast("string").alias(c) for c in along])
    return src.mapInArrow(_score(model), _OUT.replace(",", "".join(f", `{c}` string" for c in along) + ",", 1))
