"""Minimal perfect hash of a set of 64-bit keys: levels of collision-free bits with ranks.

On each level the keys are thrown into GAMMA slots a key; keys alone in their slot get its bit,
the others go on to the next level.  The index of a key is the rank of its bit, so n keys use
the numbers 0 .. n-1 at about 3 to 4 bits a key.  A key outside the set may get any number or
none: callers store a fingerprint beside it.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.text import mix

GAMMA = 2.0
_LEVELS = 64


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    scrambled = mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((scrambled >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.r_[0, np.cumsum(sizes)]
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """`keys`: distinct unsigned 64-bit numbers, fewer than 2^31."""
        sizes, words, rest, level = [], [np.zeros(0, np.uint64)], keys, 0
        while len(rest):
            if level == _LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-int(GAMMA * len(rest)) // 64) * 64 or 64
            slot = _slots(rest, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[slot]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys that are not in the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = _slots(keys[open_], level, int(size)) + self.base[level]
            word = self.words[bit >> 6]
            inside = (bit & 63).astype(np.uint64)
            hit = (word >> inside) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            out[open_[hit]] = self.ranks[bit[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return out


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one blob: count, then for each its type, length and 8-byte aligned bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind) << 8 | a.itemsize, len(a)))], "<u8")
    body = [a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays]
    return head.tobytes() + b"".join(b + bytes(-len(b) % 8) for b in body)


def unpack(blob) -> list[np.ndarray]:
    """The arrays of `pack`, without copying."""
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    head = np.frombuffer(blob, "<u8", 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for kind, length in head.reshape(-1, 2).tolist():
        dtype = np.dtype(f"<{chr(kind >> 8)}{kind & 255}")
        out.append(np.frombuffer(blob, dtype, length, at))
        at += -(-length * dtype.itemsize // 8) * 8
    return out
