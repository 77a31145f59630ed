"""FM-index over word sequences: a wavelet matrix of the BWT, searched for many patterns at once.

Suffixes are sorted by their first ``depth`` words (prefix doubling), which is all that patterns
of up to ``depth`` words need. The BWT is kept as one bit vector per bit of a word's number, 64
bits a machine word with a running count, so a rank costs one look-up and one popcount.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class FMIndex:
    """Index of sequences of word numbers (from 1 on), laid end to end with 0 after each."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.depth = depth
        self.suffixes = _sorted_suffixes(symbols, depth)
        bwt = symbols[self.suffixes - 1]  # the text counts as a ring
        top = int(symbols.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels, self.zeros = [], []
        order = bwt
        for level in range(max(top.bit_length(), 1) - 1, -1, -1):
            bits = (order >> level) & 1
            self.levels.append(Bits(bits.astype(np.uint8)))
            self.zeros.append(n - int(bits.sum()))
            order = np.concatenate([order[bits == 0], order[bits == 1]])
        # Where each symbol's run begins after the last level.
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        self.begin = np.zeros(top + 1, dtype=np.int64)
        self.begin[order[starts]] = starts

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the BWT before each position."""
        height = len(self.levels)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where((symbols >> (height - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at - self.begin[symbols]

    def matching(self, symbols: np.ndarray, ends: np.ndarray, longest: int):
        """Matching statistics: for each end (inclusive) of a place in ``symbols``, the length of the
        longest match that ends there, up to ``longest``, found more than once, and its SA interval.

        Backward search: the interval of a pattern is narrowed by the word before it, for all ends
        together; an end drops out when only its own occurrence is left.
        """
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), len(symbols), dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        alive = np.arange(len(ends))
        for k in range(longest):
            at = ends[alive] - k
            word = symbols[np.maximum(at, 0)]
            both = self.ranks(np.concatenate([word, word]), np.concatenate([low[alive], high[alive]]))
            a, b = self.first[word] + both[: len(word)], self.first[word] + both[len(word) :]
            more = (b - a > 1) & (at >= 0) & (word > 0)
            alive = alive[more]
            low[alive], high[alive] = a[more], b[more]
            length[alive] += 1
            if not len(alive):
                break
        return length, low, high


def _sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    n = len(symbols)
    rank, order, done = symbols.astype(np.int64), np.argsort(symbols, kind="stable"), 1
    while done < depth:
        key = rank * np.int64(n + 1)
        key[: n - done] += np.minimum(rank[done:], n)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        done *= 2
        if n and new[-1] == n - 1:
            break
    return order
