"""Packing along a space-filling curve: neighbouring documents share sequences.

1. Each text is encoded (an end id follows its last token) and its tokens are hashed into a vector
   of ``HASHED`` dimensions. The vector is projected to ``AXES`` dimensions with fixed random
   signs, scaled by its length, and each axis is cut into 2^``BITS`` cells: the place of the cell on
   the Hilbert curve through the grid is the document's key. All sums are whole numbers, so a
   recomputed task finds the same key.
2. The small rows (key, id, tag, tokens) are range-sorted by key, and running sums over the ranges
   give every document its place in one long line of tokens.
3. The line is cut every ``size`` tokens. What is left at its end, less than a sequence, is cut
   into sequences whose lengths are powers of two, which need no padding either; so no sequence is
   padded. The ids meet their places through one join by the unique tag, and are cut there.

A text is encoded in chunks, each distinct one of a slice once: chunks begin at a space or line
feed after a visible ASCII character or a Latin letter of two bytes. The tokenizer splits there
whatever stands around, and a special token holds no white space, so the ids are those of the
whole text.

A null text is empty and gives the end id alone. Rows with equal or null ids are documents of
their own; documents with equal keys are ordered by id, then as stored. An empty table gives no
rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm.distinct import distinct, spread
from spinecat.operators.joins import join_unique

SIZE = 1024
END_ID = 0
HASHED, AXES, BITS = 256, 4, 12
#: Bytes of text encoded at a time; the more, the fewer chunks are encoded twice.
TEXT_BYTES = 4_000_000
#: Bytes of ids in a batch of pieces, at least one document.
PIECES_BYTES = 16_000_000


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer as JSON, read where the job starts and sent along with it (a few megabytes)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as lines:
        return lines.read()


class Encoder:
    """A byte-level tokenizer, and its quick twin for plain chunks.

    Chunks of ASCII and two-byte Latin letters that begin with a space or line feed, end visibly and
    hold no `<|` are joined, encoded together by the same merges, and told apart by the bytes of
    their tokens. All others, and all chunks of a tokenizer of another kind, are encoded alone.
    """

    #: The public pattern of byte-level BPE: contractions, letters, digits, others, white space.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Bytes encoded in one call.
    PIECE = 60_000

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.alone = Tokenizer.from_str(source)
        told = json.loads(source)
        split = told.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        vocabulary = told["model"]["vocab"]
        self.size = max(self.alone.get_vocab(with_added_tokens=True).values()) + 1
        #: Stored form of an id.
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.together = None
        if plain and not told.get("normalizer") and isinstance(vocabulary, dict):
            # Printed bytes stand for themselves, the others for the code points from 256 on.
            printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            others = [x for x in range(256) if x not in set(printed)]
            back = {x: x for x in printed} | {256 + i: x for i, x in enumerate(others)}
            special = {x["content"] for x in told["added_tokens"]}
            ranks = {bytes(back[ord(x)] for x in k): v for k, v in vocabulary.items() if k not in special}
            self.widths = np.zeros(self.size, dtype=np.int64)
            self.widths[list(ranks.values())] = [len(x) for x in ranks]
            self.together = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which chunks can be joined."""
        if self.together is None:
            return np.zeros(len(starts), dtype=bool)
        lead = data == 0xC3
        odd = (data >= 0x80) & ~lead
        odd[1:] &= ~lead[:-1]
        odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
        before = np.append(0, np.cumsum(odd))
        last = data[ends - 1]
        visible = ((last > 0x20) & (last < 0x7F)) | (last >= 0x80)
        begins = (data[starts] == 0x20) | (data[starts] == 0x0A)
        return begins & visible & (before[ends] == before[starts])

    def joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain chunks and their number in each; None if a token crossed two chunks."""
        stops = np.cumsum(ends - starts)
        raw = data[spread(starts, ends - starts)].tobytes()
        found, at = [], 0
        while at < len(raw):
            stop = int(stops[np.searchsorted(stops, min(at + self.PIECE, len(raw)))])
            found.append(np.array(self.together.encode_ordinary(raw[at:stop].decode()), dtype=np.uint32))
            at = stop
        ids = np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
        reached = np.cumsum(self.widths[ids])
        lasts = np.searchsorted(reached, stops)
        if len(stops) and (lasts[-1] >= len(ids) or (reached[lasts] != stops).any()):
            return None
        return ids, np.diff(np.append(-1, lasts))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and their number in each."""
        plain = self.plain(data, starts, ends)
        quick = self.joined(data, starts[plain], ends[plain])
        if quick is None:
            plain[:] = False
            quick = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        raw = data.tobytes()
        chunks = [raw[a:b].decode() for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist())]
        single = [np.array(x.ids, dtype=np.uint32) for x in self.alone.encode_batch_fast(chunks, add_special_tokens=False)]
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[plain], counts[~plain] = quick[1], [len(x) for x in single]
        flat = np.concatenate([quick[0], *single])
        places = np.zeros(len(starts), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        places[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(places, counts)], counts


@cache
def encoder(source: str) -> Encoder:
    return Encoder(source)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where chunks begin, the starts of non-empty rows among them."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    before, second = np.zeros_like(data), np.zeros_like(data)
    before[1:], second[2:] = data[:-1], data[:-2]
    visible = ((before > 0x20) & (before < 0x7F)) | (second == 0xC3)
    begins = ((data == 0x20) | (data == 0x0A)) & visible
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


def encode(data: np.ndarray, offsets: np.ndarray, own: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a slice one after the other, and their number in each row."""
    starts = chunk_starts(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    rows = np.searchsorted(offsets, starts, side="right") - 1
    first, inverse = distinct(data, starts, ends, np.zeros(len(starts), dtype=np.int64))
    flat, lengths = own.encode(data, starts[first], ends[first])
    places = np.cumsum(lengths) - lengths
    ids = flat[spread(places[inverse], lengths[inverse])]
    return ids, c.per_row(lengths[inverse], rows, len(offsets) - 1)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds the end id to each row."""
    stops = np.cumsum(counts + 1) - 1
    out = np.empty(len(ids) + len(counts), dtype=np.uint32)
    out[stops] = end_id
    kept = np.ones(len(out), dtype=bool)
    kept[stops] = False
    out[kept] = ids
    return out, counts + 1


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid cell (one row of coordinates below 2^bits) on the Hilbert curve.

    From the highest bit down, a set bit of an axis mirrors the lower bits of the first axis and an
    unset one swaps them with its own; the Gray code of the bits, interleaved, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(axes):
            up = (x[axis] & bit) != 0
            moved = np.where(up, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ moved)
            x[axis] ^= moved if axis else 0
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    fold = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fold ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= fold
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _signs(n: int, salt: int) -> np.ndarray:
    """n fixed random signs."""
    return (c.mix(np.arange(n, dtype=np.uint64) + np.uint64(salt << 32)) >> np.uint64(63)).astype(np.int64) * 2 - 1


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids (end ids included)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    hashed = c.mix(ids.astype(np.uint64) + np.uint64(7))
    signs = (hashed >> np.uint64(63)).astype(np.int64) * 2 - 1
    place = rows * HASHED + (hashed % np.uint64(HASHED)).astype(np.int64)
    vectors = np.bincount(place, weights=signs, minlength=len(counts) * HASHED).astype(np.int64).reshape(-1, HASHED)
    axes = vectors @ np.stack([_signs(HASHED, k + 1) for k in range(AXES)], axis=1)
    length = np.sqrt((vectors * vectors).sum(axis=1)) + 1e-9
    # A projection of a unit vector on HASHED random signs has about the spread 1; cells cover 3 of it.
    scaled = (axes / length[:, None] + 3.0) / 6.0
    return hilbert_key(np.clip((scaled * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def _encoded(shared: Broadcast, end_id: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in stream:
            for rows, data, offsets in c.slices(batch, "text", TEXT_BYTES):
                ids, counts = with_end(*encode(data, offsets, own), end_id)
                stops = np.append(0, np.cumsum(counts))
                raw = ids.astype(own.kind).tobytes()
                cuts = (stops * own.kind.itemsize).tolist()
                packed = pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], type=pa.binary())
                new = [pa.array(curve_keys(ids, counts)), pa.array(counts), packed]
                yield pa.record_batch([rows.column(0), *new], names=["id_", "key", "n", "ids"])

    return run


def tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """id_, key, n, ids (in the encoder's stored form) and a unique tag of each document, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(source or tokenizer_file())
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id_"].dataType.simpleString()
    encoded = rows.mapInArrow(_encoded(shared, end_id), f"id_ {kind}, key long, n long, ids binary")
    return c.write_rows(encoded.withColumn("tag", F.monotonically_increasing_id()), "tokens")


def line(encoded: DataFrame) -> DataFrame:
    """tag and first place of each document in the line of all tokens, in order of the curve."""
    order = ["key", "id_", "tag"]
    dealt = encoded.select(*order, "n").repartitionByRange(*order).withColumn("stretch", F.spark_partition_id())
    fixed = c.write_rows(dealt, "curve")  # the ranges must not move between the two passes
    totals = fixed.groupBy("stretch").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("stretch", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = fixed.withColumn("until", F.sum("n").over(within))
    return join_unique(summed, bases, ["stretch"]).select("tag", (F.col("base") + F.col("until") - F.col("n")).alias("place"))


def tail_starts(total: int, size: int) -> list[int]:
    """Where the last sequences begin, each as long as a power of two, the longest first."""
    at, out = total - total % size, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return out


def _cut(kind: np.dtype, size: int, whole: int, tail: list[int], names: list[str]):
    """Pieces of documents at their places in the line."""
    tails = np.array(tail, dtype=np.int64)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = {x: batch.column(batch.schema.get_field_index(x)) for x in batch.schema.names}
            rows, begins, lengths, held, sequence, offsets, weight = [], [], [], [], [], [], 0

            def out():
                numbers = [np.concatenate(x) for x in (begins, lengths)]
                at = np.concatenate(rows)
                columns = [
                    column["id_"].take(pa.array(at)), *map(pa.array, numbers), pa.array(held, type=pa.binary()),
                    column["n"].take(pa.array(at)), pa.array(np.concatenate(sequence)), pa.array(np.concatenate(offsets)),
                ]
                return pa.record_batch(columns, names=names)

            for row, (place, ids) in enumerate(zip(column["place"].to_pylist(), column["ids"])):
                own = np.frombuffer(ids.as_buffer(), dtype=kind).astype("<u4")
                end = place + len(own)
                first = place - place % size + size
                inside = np.arange(first, min(end, whole + 1), size)
                late = tails[(tails > max(place, whole)) & (tails < end)]
                starts = np.concatenate([[place], inside[inside < end], late]).astype(np.int64)
                stops = np.append(starts[1:], end)
                number = np.searchsorted(tails, starts, side="right") - 1
                rows.append(np.full(len(starts), row))
                begins.append(starts - place)
                lengths.append(stops - starts)
                held.extend(own[a - place : b - place].tobytes() for a, b in zip(starts.tolist(), stops.tolist()))
                sequence.append(np.where(starts < whole, starts // size, whole // size + number))
                base = tails[np.maximum(number, 0)] if len(tails) else starts
                offsets.append(np.where(starts < whole, starts % size, starts - base))
                weight += own.nbytes
                if weight > PIECES_BYTES:
                    yield out()
                    rows, begins, lengths, held, sequence, offsets, weight = [], [], [], [], [], [], 0
            if rows:
                yield out()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    source: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: the id column, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset."""
    source = source or tokenizer_file()
    encoded = tokens(docs, id_col, text_col, source, end_id)
    total = encoded.agg(F.sum("n")).first()[0] or 0  # one number
    placed = join_unique(encoded.select("id_", "tag", "n", "ids"), line(encoded), ["tag"]).select("id_", "n", "ids", "place")
    kind = encoded.schema["id_"].dataType.simpleString()
    names = ["id_", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    layout = f"id_ {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    cut = _cut(encoder(source).kind, size, total - total % size, tail_starts(total, size), names)
    return placed.mapInArrow(cut, layout).withColumnRenamed("id_", id_col)


def ids_crc32() -> Column:
    """crc32 of a piece's ids as unsigned little-endian 32-bit numbers."""
    return F.crc32("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n and ids of every packed sequence; a group has at most ``size`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", "n", joined.alias("ids"))
