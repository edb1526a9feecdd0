"""Distinct spans of many texts: each is worked out once in a task and gathered wherever it stands.

A chunk is a stretch of bytes with its spans (words, say).  Texts longer than a chunk come in several chunks, so
memory follows the chunk and not the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from chronolith.llm.common import Slice, slices, span_hashes

#: Bytes of a chunk, spans that are remembered at most, and the longest span that is remembered.
CHUNK = 1 << 20
KNOWN = 500_000
LONGEST = 1 << 14


def chunks(column: pa.Array, cut: Callable[[np.ndarray, int], int], limit: int = CHUNK) -> Iterator[tuple[Slice, bool]]:
    """(slice of texts, whether its last text goes on in the next slice).

    A text longer than `limit` is cut where `cut(data, at)` says: the first place at or after `at` where spans
    may part, the length where there is none.
    """
    for s in slices(column, limit):
        if len(s.data) <= limit:
            yield s, False
            continue
        at = 0
        while at < len(s.data):
            end = int(cut(s.data, at + limit)) if len(s.data) - at > limit else len(s.data)
            yield Slice(s.first, s.last, s.data[at:end], np.array([0, end - at])), end < len(s.data)
            at = end


class Pool:
    """A growing array."""

    def __init__(self, dtype):
        self.values, self.size = np.zeros(1 << 12, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.values):
            grown = np.zeros(max(need, 2 * len(self.values)), self.values.dtype)
            grown[:self.size] = self.values[:self.size]
            self.values = grown
        self.values[self.size:need] = more
        self.size = need


class Memory:
    """Numbers the distinct spans it meets by their 64-bit hashes; `learn` is given the new ones in order.

    `forget` empties what `learn` has kept; it is called when KNOWN spans are held and more would come.  A span
    longer than LONGEST gets a number of its own each time and is not kept by its hash.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], known: int = KNOWN):
        self.learn, self.forget, self.limit = learn, forget, known
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows, self.made = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every span of a chunk."""
        long = ends - starts > LONGEST
        if not long.any():
            return self._short(data, starts, ends)
        # Long spans are cut out, so that hashing never runs over them.
        out = np.zeros(len(starts), np.int64)
        keep = np.ones(len(data), bool)
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            keep[a:b] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        short = ~long
        out[short] = self._short(data[keep], place[starts[short]], place[ends[short]])
        self.learn([data[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        out[long] = self.made + np.arange(int(long.sum()))
        self.made += int(long.sum())
        return out

    def _short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(data, starts, ends, fold=False)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit or self.made > 2 * self.limit:
            self.forget()
            self._clear()
        at = np.searchsorted(self.keys, unique)
        hit = np.zeros(len(unique), bool)
        if len(self.keys):
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == unique
        rows = np.zeros(len(unique), np.int64)
        rows[hit] = self.rows[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            raw = data.tobytes()
            self.learn([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            rows[new] = self.made + np.arange(len(new))
            self.made += len(new)
            keys, numbers = np.concatenate([self.keys, unique[new]]), np.concatenate([self.rows, rows[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], numbers[order]
        return rows[inverse]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
