"""Shared helpers: tables, scratch folders, and word scans over Arrow text columns.

The scans work on the UTF-8 bytes of a slice of rows at a time with numpy, so a word costs
nanoseconds rather than a Python loop. Every word class used here is a set of bytes that holds
whole characters (ASCII separators, and all bytes from 0x80 on), so byte scans and code point
scans agree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat.session import configure, write_rows

#: Bytes of text a task holds as numpy arrays at a time; longer single texts are scanned alone.
SLICE_BYTES = 2_000_000

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the path of Python workers that share the file system.

    Where they do not, the package is sent along with the application, as any other.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: Column | str, divisor: int) -> Column:
    """crc32 of the value's text, modulo ``divisor``; null stays null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return (F.crc32(F.encode(text, "UTF-8")) % divisor).cast("int")


def in_share(hashed: Column, share: float) -> Column:
    """Rows whose 64-bit hash lies in the lowest ``share`` of its range."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(hashed, F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows of the batch, bytes, offsets) of consecutive slices; a null text is empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Byte starts, byte ends and row of every word; words never run over two rows."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(counts)), counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of a fixed odd number and of its inverse modulo 2^64, grown on demand.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        have = _POWERS[key]
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _POWERS[key] = have
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, the same for the same bytes in every task."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * ODD))


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words within one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total *= ODD
        total += words[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return first, mix(total[first])


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words [begin, end), the same wherever the run stands."""
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def cover(firsts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window of ``size`` words that starts at a first."""
    delta = np.zeros(n + 1, dtype=np.int32)
    np.add.at(delta, firsts, 1)
    np.add.at(delta, np.minimum(firsts + size, n), -1)
    return np.cumsum(delta[:n]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position, one entry more than bytes."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of ``n`` rows, as whole numbers."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, dtype=np.int64)
