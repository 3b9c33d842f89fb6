"""Minimal perfect hash of a set of 64-bit word hashes, in arrays.

Keys are placed level by level: on each level a key sets one bit of a bit array,
bits that two keys would set stay empty, and the keys that met there go on to
the next level. A key's number is the count of bits set before its own, so n
keys get the numbers 0 to n - 1 and the structure takes about 3 bits a key. A
value that is no key may find a number, too; the caller compares the key that
it keeps at that number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from polarity.functions.word_runs import finish

_SPREAD = 0x9E3779B97F4A7C15


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (finish(keys + np.uint64((level + 1) * _SPREAD % 2**64)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    bits: list[np.ndarray]    # 64 bits a word, by level
    before: list[np.ndarray]  # bits set before each word, all levels counted
    n: int

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        bits, before, count, rest, level = [], [], 0, keys, 0
        while len(rest):
            words = -(-len(rest) * 5 // 4 // 64) + 1
            at = _bit(rest, level, words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            word = np.packbits(alone, bitorder="little").view(np.uint64)
            per = np.bitwise_count(word).astype(np.int64)
            bits.append(word)
            before.append(count + np.cumsum(per) - per)
            count += int(per.sum())
            rest, level = rest[~alone[at]], level + 1
        return cls(bits, before, len(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; of other values a number or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (word, before) in enumerate(zip(self.bits, self.before)):
            at = _bit(keys[open_], level, len(word) * 64)
            own = word[at >> 6]
            shift = (at & 63).astype(np.uint64)
            hit = (own >> shift) & np.uint64(1) == 1
            low = own[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[open_[hit]] = before[at[hit] >> 6] + np.bitwise_count(low)
            open_ = open_[~hit]
        return out
