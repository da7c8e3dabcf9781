"""An open-addressing hash table in numpy arrays, for many keys at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class HashTable:
    """Non-zero 64-bit keys to non-negative integers, at most half full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        bits = max(4, int(2 * capacity).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is absent."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not in the table yet."""
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[rest[free]]
            won = free & (self.keys[s] == keys[rest])
            self.values[s[won]] = values[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def grown(self, capacity: int) -> HashTable:
        """The same keys and values in a table for `capacity` keys."""
        out, full = HashTable(capacity), np.flatnonzero(self.keys)
        out.insert(self.keys[full], self.values[full])
        return out
