"""The best rows of each query, kept while batches pass."""

from __future__ import annotations

import numpy as np

#: Scores that a worker holds at once (4 MiB).
CELLS = 1 << 19


class Best:
    """The ``k`` best (score, then smaller id) of each of ``n`` queries so far; what can't be among them any more is dropped at once."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, s: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """Scores of queries (those of the numbers ``of``, else all) by rows, -inf where a row is no hit."""
        m = (s >= (self.least if of is None else self.least[of])[:, None]) & (s > -np.inf)
        if s.shape[1] > self.k and np.count_nonzero(m) > 2 * self.k * len(s):
            m &= s >= np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
        q, c = np.nonzero(m)
        if not len(q):
            return
        query, score = np.concatenate([self.query, q if of is None else of[q]]), np.concatenate([self.score, s[q, c]])
        ids = ids[c] if self.ids is None else np.concatenate([self.ids, ids[c]])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        size = np.diff(np.append(first, len(query)))
        place = np.arange(len(query)) - np.repeat(first, size)
        self.query, self.score, self.ids = query[place < self.k], score[order][place < self.k], ids[order][place < self.k]
        full = place == self.k - 1
        self.least[query[full]] = score[order][full]
