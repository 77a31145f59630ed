"""Minimal perfect hashes over 64-bit key hashes, with the keys stored for verification.

A shard is built in levels: the keys left over from the level before are thrown into about twice as
many bits, and every bit that exactly one key hits stays set. The number of set bits before a key's
bit is its slot, so n keys have the slots 0 to n - 1. Keys that share a 64-bit hash can share no
level; they have the last slots and are looked up by their bytes. A word that is no key falls on
some slot too, so its bytes are compared with the stored ones.
"""

from __future__ import annotations

import numpy as np

from spinecat.llm import common as c
from spinecat.llm.distinct import same_bytes

GAMMA = 2.0
LEVELS = 48


def _seeded(hashes: np.ndarray, level: int) -> np.ndarray:
    return c.mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _before(words: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bitwise_count(words).astype(np.int64))])


def build(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit words of each level, the words of all levels, the slot of each key)."""
    sizes, bits, slots, base = [], [], np.zeros(len(hashes), dtype=np.int64), 0
    left = np.arange(len(hashes))
    for level in range(LEVELS):
        if not len(left):
            break
        n_words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = (_seeded(hashes[left], level) % np.uint64(n_words * 64)).astype(np.int64)
        hit = np.bincount(at, minlength=n_words * 64)
        alone = hit == 1
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        slots[left[placed]] = base + rank[at[placed]]
        base += int(alone.sum())
        sizes.append(n_words)
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~placed]
    slots[left] = base + np.arange(len(left))
    words = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint64)
    return np.array(sizes, dtype=np.int64), words, slots


class Shards:
    """Several shards side by side; a word is looked up in its own shard, all words at once.

    ``parts`` has (words of each level, words of all levels, keys in slot order) of each shard.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, list[bytes]]]):
        n = len(parts)
        depth = max((len(p[0]) for p in parts), default=0)
        self.sizes = np.zeros((depth, n), dtype=np.int64)
        self.offsets = np.zeros((depth, n), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]).astype(np.int64)
        for i, (sizes, _, _) in enumerate(parts):
            self.sizes[: len(sizes), i] = sizes
            self.offsets[: len(sizes), i] = starts[i] + np.cumsum(sizes) - sizes
        self.words = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
        self.before = _before(self.words)
        counts = np.array([len(p[2]) for p in parts], dtype=np.int64)
        #: First slot of each shard, and the end of the last.
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        keys = [k for p in parts for k in p[2]]
        self.data = np.frombuffer(b"".join(keys), dtype=np.uint8)
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: Keys without a bit of their own, by shard and bytes.
        self.rest = {}
        for i, (_, words, own) in enumerate(parts):
            for k in range(int(np.bitwise_count(words).sum()), len(own)):
                self.rest[(i, own[k])] = int(self.base[i]) + k
        self.shift = self.base[:-1] - self.before[starts[:-1]] if n else np.zeros(0, dtype=np.int64)

    def slots(self, hashes: np.ndarray, shards: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each word that is a key of its shard, -1 of the others; shard -1 has no key."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.flatnonzero(shards >= 0)
        for level in range(len(self.sizes)):
            size = self.sizes[level][shards[todo]]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = (_seeded(hashes[todo], level) % (size * 64).astype(np.uint64)).astype(np.int64)
            word = self.offsets[level][shards[todo]] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            lower = self.words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            chosen = todo[found]
            out[chosen] = self.before[word[found]] + np.bitwise_count(lower) + self.shift[shards[chosen]]
            todo = todo[~found]
        held = np.flatnonzero(out >= 0)
        lengths = ends[held] - starts[held]
        equal = lengths == self.lengths[out[held]]
        out[held[~equal]] = -1
        held, lengths = held[equal], lengths[equal]
        equal = same_bytes(data, starts[held], self.data, self.starts[out[held]], lengths)
        out[held[~equal]] = -1
        if self.rest:
            for i in np.flatnonzero((out < 0) & (shards >= 0)).tolist():
                out[i] = self.rest.get((int(shards[i]), data[starts[i] : ends[i]].tobytes()), -1)
        return out
