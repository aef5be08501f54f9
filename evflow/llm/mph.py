"""Minimal perfect hashing of distinct 64-bit keys: level after level of bits, each set where one key alone falls."""

from __future__ import annotations

import numpy as np


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places 0 to n - 1 of n keys, and the keys by place, with which every place is verified."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, keys: np.ndarray):
        self.sizes, self.words, self.keys = sizes, words, keys
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.begins = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5) -> PerfectHash:
        """Hash ``keys``, which must be distinct; each level has ``room`` bits a key that is left."""
        left, sizes, bits = np.asarray(keys, np.int64), [], []
        while len(left):
            size = -(-int(room * len(left) + 1) // 64) * 64
            at = (_spread(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            if len(sizes) > 200:
                raise ValueError("keys aren't distinct")
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        new = cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.zeros(len(keys), np.int64))
        place = new._places(np.asarray(keys, np.int64))
        ordered = np.empty(len(keys), np.int64)
        ordered[place] = keys
        new.keys = ordered
        return new

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where no level has a bit for it."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(rest):
                break
            at = self.begins[level] + (_spread(keys[rest], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = word & bit > 0
            out[rest[hit]] = (self.before[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))))[hit]
            rest = rest[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, verified; -1 for a key that isn't among the hashed ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._places(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)
