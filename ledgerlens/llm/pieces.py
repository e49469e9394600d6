"""Remembers the token ids of text pieces, so that each is encoded once while it is in use."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

from .text import ragged

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Buffer:
    """An array that grows in place: few large allocations, whatever the number of additions."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need

    def reset(self, values: np.ndarray) -> None:
        self.size = 0
        self.add(values)

    @property
    def view(self) -> np.ndarray:
        return self.data[: self.size]


class PieceCache:
    """Ids of pieces by one look-up each. ``learn`` gives the ids of new pieces end to end and
    their numbers. Beyond ``limit`` pieces those met once only are dropped (all of them, if the
    others fill half of it); only speed depends on what is remembered."""

    def __init__(self, learn: Learn, limit: int):
        self.learn, self.limit = learn, limit
        self.index: dict[str, int] = {}
        self.flat, self.n, self.hits = _Buffer(np.uint32), _Buffer(np.int32), _Buffer(np.int32)
        self.at = _Buffer(np.int64)

    def _add(self, new: list[str]) -> None:
        flat, n = self.learn(new)
        self.index.update(zip(new, range(self.n.size, self.n.size + len(new)), strict=True))
        self.at.add(self.flat.size + np.cumsum(n) - n)
        self.flat.add(flat)
        self.n.add(n)
        self.hits.add(np.zeros(len(new), np.int32))

    def _forget(self) -> None:
        live = np.flatnonzero(self.hits.view > 1)
        live = live if len(live) < self.limit // 2 else live[:0]
        keep = np.full(self.n.size, -1)
        keep[live] = np.arange(len(live))
        self.index = {p: k for p, k in zip(self.index, keep.tolist(), strict=True) if k >= 0}
        n = self.n.view[live].astype(np.int64)
        self.flat.reset(self.flat.view[ragged(self.at.view[live], n)])
        self.n.reset(n)
        self.at.reset(np.cumsum(n) - n)
        self.hits.reset(np.ones(len(live), np.int32))

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        if len(self.index) > self.limit:
            self._forget()
        where = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(unknown)))
            where[missing] = list(map(self.index.__getitem__, unknown))
        self.hits.view[:] += np.bincount(where, minlength=self.hits.size).astype(np.int32)
        n = self.n.view[where].astype(np.int64)
        return self.flat.view[ragged(self.at.view[where], n)], n


def per_text(n: np.ndarray, pieces_of_text: list[int]) -> np.ndarray:
    """Sums of ``n`` over each text's pieces."""
    ends = np.concatenate([[0], np.cumsum(n)])
    b = np.concatenate([[0], np.cumsum(np.array(pieces_of_text, np.int64))])
    return ends[b[1:]] - ends[b[:-1]]
