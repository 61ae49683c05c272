"""Minimal perfect hashing of whole numbers, level by level, in numpy."""

from __future__ import annotations

import numpy as np

#: Places a level has for each key that comes to it.
ROOM = 1.5


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key; different keys never share them under one seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Different keys to the numbers from 0 up to as many as there are.

    A key that has a place of a level to itself sets that place's bit, the others go on to the next level, which has
    another hash. A key's number is the count of bits set before its own. About four bits are kept for a key, and no key:
    any other key also gets a number, or -1, so that whoever looks up must compare keys.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of an array of different keys."""
        sizes, words, left = [], [np.zeros(0, np.uint64)], keys
        while len(left):
            size = -(-int(ROOM * len(left)) // 64) * 64
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            here = self.bits[word] >> bit & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found = self.before[word] + np.bitwise_count(below)
            out[left[here]] = found[here]
            left = left[~here]
        return out
