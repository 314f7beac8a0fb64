"""Vectorised word arrays over Arrow text columns.

Words, word hashes and hashes of word windows are computed with numpy on the UTF-8 bytes of a slice of rows,
so no Python object is made per word.  Slices are bounded in bytes and rows; a text is never split or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64


def _give_back() -> None:
    """Return large arrays to the system when they are freed: idle workers then hold little beside an executor's heap (glibc only)."""
    import contextlib
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


_give_back()
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: After lower-casing: ASCII bytes that are neither a letter nor a digit separate words; other bytes are word bytes.
_IS_PUNCT = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x + U(seed)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches into zero-copy slices of about ``max_bytes`` of text; a longer text is a slice of its own."""
    for batch in batches:
        off, at = text_bytes(batch.column(column))[1], 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
            end = max(at + 1, min(end, at + max_rows, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


class Words:
    """Words of some rows: byte ``start`` and ``length`` each, ``first[r]:first[r+1]`` are the words of row r."""

    def __init__(self, col: pa.Array, lower: bool = False, punctuation: bool = False):
        buf, self.off = text_bytes(col)
        self.buf = _LOWER[buf] if lower else buf
        n, rows = len(buf), len(self.off) - 1
        if n:
            inside = ~(_IS_PUNCT if punctuation else _IS_WS)[self.buf]
            begin, end = inside.copy(), inside.copy()
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = self.off[:-1][self.off[1:] > self.off[:-1]]
            begin[full] = inside[full]  # a word never crosses from one row into the next
            last = self.off[1:][self.off[1:] > self.off[:-1]] - 1
            end[last] = inside[last]
            self.start = np.flatnonzero(begin)
            self.length = np.flatnonzero(end) + 1 - self.start
        else:
            self.start = self.length = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.off) if n else np.zeros(rows + 1, np.int64)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.length)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.length[i]].tobytes()


def hash_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time; spans over 4 KiB go through xxhash."""
    if not len(start):
        return np.empty(0, U)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = mix(length.astype(U), 0x1234567)
    h = mix(h ^ (at[start] & _MASKS[np.minimum(length, 8)]))
    more, k = np.flatnonzero((length > 8) & (length <= 4096)), 8
    while len(more):
        left = length[more] - k
        h[more] = mix((h[more] * U(_BASE)) ^ (at[start[more] + k] & _MASKS[np.minimum(left, 8)]))
        more, k = more[left > 8], k + 8
    for i in np.flatnonzero(length > 4096):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : start[i] + length[i]].tobytes())
    return h


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, U)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U(pow(base, have, 1 << 64))
        have += take
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of k consecutive hashes (rows are not looked at here)."""
    n = len(h)
    if n < k:
        return np.empty(0, U)
    size = 1 << max(10, (n - 1).bit_length())
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(h * _powers(_INV, size)[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_BASE, size)[: n - k + 1])


def starts_of_windows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the n-k+1 windows: those that lie in one row."""
    ok = np.zeros(max(0, n - k + 1), bool)
    if len(ok):
        delta = np.zeros(n + 2, np.int32)
        lo, hi = first[:-1], first[1:] - k + 1
        good = hi > lo
        np.add.at(delta, lo[good], 1)
        np.add.at(delta, hi[good], -1)
        ok = np.cumsum(delta)[: len(ok)] > 0
    return ok


def per_row(values: np.ndarray, first: np.ndarray, how=np.add, empty=0) -> np.ndarray:
    """reduceat by row, where rows may be empty."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = how.reduceat(values, first[:-1][full])
    return out


def planes(x: np.ndarray, kind: str) -> bytes:
    """Integers with their bytes in planes, so that the shuffle's compression removes the zero planes."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def groups_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by small integer key, the keys that occur, and the bounds of their runs."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 65536 else key, kind="stable")
    sorted_ = key[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(key) else np.empty(0, np.int64)
    return order, sorted_[cut], np.append(cut, len(key))


def six(x: np.ndarray) -> bytes:
    """The low six bytes of each integer."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()
