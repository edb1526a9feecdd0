"""Minimal perfect hashing: n distinct 64-bit keys to the places 0 .. n - 1."""

from __future__ import annotations

import numpy as np

from chronolith.llm.common import mix

#: Bits of a level for each key that is still without a place.
GAMMA = 2


class PerfectHash:
    """Levels of bits.  A key that is alone at its place in a level sets the bit; the others go on to the next level.

    A key's number is the count of bits set before its own.  Keys that were not built in may find a place too, so
    callers keep the keys by number and compare.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = list(sizes)
        packed, self.levels, self.ranks, at, base = np.frombuffer(bits, np.uint8), [], [], 0, 0
        for size in self.sizes:
            level = np.unpackbits(packed[at:at + -(-size // 8)], count=size).astype(bool)
            self.levels.append(level)
            self.ranks.append(base + np.cumsum(level) - 1)
            base += int(level.sum())
            at += -(-size // 8)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[list[int], bytes]:
        """(sizes of the levels, their bits) for distinct keys."""
        keys = keys.astype(np.uint64)
        sizes, bits = [], []
        while len(keys):
            size = max(GAMMA * len(keys), 8)
            at = cls.place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            keys = keys[~alone[at]]
        return sizes, b"".join(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level has its bit."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (size, level, rank) in enumerate(zip(self.sizes, self.levels, self.ranks)):
            if not len(left):
                break
            at = self.place(keys[left], k, size)
            hit = level[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out
