"""Distinct byte strings of a slice of texts, and counts of them that a task adds up.

Strings are found by a 64-bit hash and then compared byte by byte with the first of their hash, so
the result is exact; a slice with two different strings of one hash is grouped by a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spinecat.llm import common as c

#: Entries a task adds up before it passes them on.
ENTRIES = 300_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every string, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[start:start + length] equals b[start:start + length], for strings of one byte or more."""
    if not len(lengths):
        return np.zeros(0, dtype=bool)
    differs = a[spread(a_starts, lengths)] != b[spread(b_starts, lengths)]
    return ~np.logical_or.reduceat(differs, np.cumsum(lengths) - lengths)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray, hashes: np.ndarray | None = None):
    """(first, inverse): a place of each distinct (group, string), and each place's number among them."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = c.word_hashes(data, starts, ends) if hashes is None else hashes
    keys = c.mix(hashes + groups.astype(np.uint64) * c.ODD)
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    lengths, chosen = ends - starts, first[inverse]
    same = (lengths == lengths[chosen]) & (groups == groups[chosen])
    if same.all() and same_bytes(data, starts, data, starts[chosen], lengths).all():
        return first, inverse
    seen: dict = {}
    raw = data.tobytes()
    inverse = np.array([seen.setdefault((g, raw[a:b]), len(seen)) for g, a, b in zip(groups.tolist(), starts, ends)])
    _, first = np.unique(inverse, return_index=True)
    return first, inverse


class Counter:
    """Adds up counts by key; ``full`` says when to pass them on."""

    def __init__(self):
        self.counts: dict = {}

    def add(self, keys, numbers) -> None:
        counts = self.counts
        for key, n in zip(keys, numbers):
            counts[key] = counts.get(key, 0) + n

    @property
    def full(self) -> bool:
        return len(self.counts) >= ENTRIES

    def taken(self) -> dict:
        counts, self.counts = self.counts, {}
        return counts


def batches(columns: dict[str, tuple[list, pa.DataType]], limit: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from columns of values."""
    n = len(next(iter(columns.values()))[0])
    for at in range(0, n, limit):
        yield pa.record_batch({k: pa.array(v[at : at + limit], type=kind) for k, (v, kind) in columns.items()})
