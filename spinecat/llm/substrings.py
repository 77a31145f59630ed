"""Substring dedup: passages of ``window`` words that an earlier document also has are removed.

Routing. Every window of 13 words has an anchor, the 6-word run of least hash in it (the leftmost
of equals), so equal windows have equal anchors. Anchors that two documents share mark where
repeats can be; consecutive windows with one anchor form a segment. Equal segments collapse to one
row with the least document id. Segments go to shards by anchor, about ``SHARD`` of them to each.
An anchor of more than ``HOT`` documents is split: each of its windows is a segment of its own,
routed by its own hash.

Search. A shard's segments are indexed in a compressed FM-index (see ``fm_index``). Every segment
is streamed past it; backward search gives, for each word, the longest match that ends there and
the interval of the suffix array with all its occurrences. Where the match reaches the window's
length, the least document id over the interval says from which document on the window is a
repeat. Words are compared as themselves; hashes only route.

Ids are compared as they are ordered; a null id neither removes nor loses words. Rows with equal id
and text are the same; rows with equal ids do not remove each other's words. A null text has no
words. An empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm.fm_index import FMIndex
from spinecat.llm.language import Words

GRAM = 6
HOT = 4096
SHARD = 20_000


def _anchored(hashes: np.ndarray, rows: np.ndarray, window: int):
    """First words of all windows, and for each the place and hash of its anchor."""
    gram = min(GRAM, window)
    places = window - gram + 1
    at, values = c.window_hashes(hashes, rows, gram)
    # The low bits make room for the place in the window, so a minimum finds hash and place.
    low = np.uint64((1 << (places - 1).bit_length()) - 1)
    full = np.zeros(len(hashes), dtype=np.uint64)
    full[at] = values & ~low
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    best = full[:n].copy()
    for k in range(1, places):
        np.minimum(best, full[k : k + n] | np.uint64(k), out=best)
    firsts = np.flatnonzero(rows[:n] == rows[window - 1 :])
    best = best[firsts]
    return firsts, firsts + (best & low).astype(np.int64), best & ~low


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Distinct (id_, anchor) of every row."""

    def scan(batches):
        for batch in batches:
            for part, data, offsets in c.slices(batch, "text_"):
                starts, ends, rows = c.word_spans(data, offsets, c.SPACES)
                firsts, _, anchors = _anchored(c.word_hashes(data, starts, ends), rows, window)
                own = rows[firsts]
                change = np.ones(len(firsts), dtype=bool)
                change[1:] = (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])
                own, anchors = own[change], anchors[change]
                _, once = np.unique(c.mix(anchors + c.ODD * own.astype(np.uint64)), return_index=True)
                ids = part.column(0).take(pa.array(own[once]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(anchors[once].view(np.int64))], ["id_", "anchor"])

    kind = docs.schema["id_"].dataType.simpleString()
    return docs.filter("id_ is not null").select("id_", "text_").mapInArrow(scan, f"id_ {kind}, anchor long")


def _segments(candidates: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(id_, digest_, first, route, text_hash) of all windows with a shared anchor; or, with the
    text, (id_, route, text_hash, segment)."""

    def scan(batches):
        for batch in batches:
            for part, data, offsets in c.slices(batch, "text_"):
                starts, ends, rows = c.word_spans(data, offsets, c.SPACES)
                hashes = c.word_hashes(data, starts, ends)
                firsts, places, anchors = _anchored(hashes, rows, window)
                shared = part.column(part.schema.get_field_index("shared"))
                flat, owner = shared.flatten(), np.asarray(pc.list_parent_indices(shared))
                known = flat.field("anchor").to_numpy().view(np.uint64)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                # One number per (row, anchor), on both sides.
                keys = c.mix(known + c.ODD * owner.astype(np.uint64))
                order = np.argsort(keys)
                mine = c.mix(anchors + c.ODD * rows[firsts].astype(np.uint64))
                at = order[np.minimum(np.searchsorted(keys[order], mine), len(keys) - 1)]
                keep = keys[at] == mine
                firsts, places, anchors, split = firsts[keep], places[keep], anchors[keep], hot[at[keep]]
                if not len(firsts):
                    continue
                new = np.ones(len(firsts), dtype=bool)
                new[1:] = (places[1:] != places[:-1]) | (firsts[1:] != firsts[:-1] + 1) | split[1:]
                lead = np.flatnonzero(new)
                begin, end = firsts[lead], firsts[np.append(lead[1:], len(firsts)) - 1] + window
                whole = c.run_hashes(hashes, begin, end)
                route = pa.array(np.where(split[lead], whole, anchors[lead]).view(np.int64))
                whole = pa.array(whole.view(np.int64))
                row = rows[begin]
                take = pa.array(row)
                if with_text:
                    raw = data.tobytes()
                    texts = [raw[a:b] for a, b in zip(starts[begin].tolist(), ends[end - 1].tolist(), strict=True)]
                    own = [part.column(0).take(take), route, whole, pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(own, ["id_", "route", "text_hash", "segment"])
                else:
                    base = np.searchsorted(rows, np.arange(part.num_rows))
                    first = pa.array((begin - base[row]).astype(np.int64))
                    own = [part.column(0).take(take), part.column(1).take(take), first, route, whole]
                    yield pa.RecordBatch.from_arrays(own, ["id_", "digest_", "first", "route", "text_hash"])

    kind = candidates.schema["id_"].dataType.simpleString()
    schema = "route long, text_hash long, segment string" if with_text else "digest_ long, first long, route long, text_hash long"
    return candidates.select("id_", "digest_", "text_", "shared").mapInArrow(scan, f"id_ {kind}, {schema}")


def _search(units: pa.Table, window: int, kind: pa.DataType) -> pa.Table:
    """For every segment of a shard, the least id that has each of its windows."""
    names = ["route", "text_hash", "last", "earliest"]
    column = units.column("segment").combine_chunks().cast(pa.large_string())
    batch = pa.RecordBatch.from_arrays([column], ["text_"])
    symbols, rows = [], []
    numbers = Words()
    at = 0
    for part, data, offsets in c.slices(batch, "text_"):
        _, _, own = c.word_spans(data, offsets, c.SPACES)
        texts = part.column(0).cast(pa.large_binary()).to_pylist()
        words = np.fromiter(map(numbers.__getitem__, b"\n".join(texts).split()), np.int64, len(own)) + 1
        # A 0 after the words of each row.
        gaps = np.searchsorted(own, np.arange(part.num_rows), side="right")
        symbols.append(np.insert(words, gaps, 0))
        rows.append(np.insert(own, gaps, np.arange(part.num_rows)) + at)
        at += part.num_rows
    symbols, rows = np.concatenate(symbols), np.concatenate(rows)
    index = FMIndex(symbols, window)
    starts = np.searchsorted(rows, np.arange(at))
    sizes = np.diff(np.append(starts, len(rows))) - window  # windows of each row, the 0 taken out
    owner = np.repeat(np.arange(at), sizes)
    ends = np.repeat(starts + window - 1, sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length, low, high = index.matching(symbols, ends, window)
    # Ids as ranks, so that any ordered type compares.
    ids = units.column("least").combine_chunks()
    ranks = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
    by_rank = ids.take(pc.sort_indices(ids)).unique() if len(ids) else ids
    by_place = ranks[rows[index.suffixes]]
    earliest = ranks[owner]
    full = np.flatnonzero(length >= window)
    intervals, back = np.unique(low[full], return_inverse=True)
    if len(full):
        # Occurrences of one pattern are one interval; those of two are apart.
        upper = np.zeros(len(intervals), dtype=np.int64)
        upper[back] = high[full]
        bounds = np.stack([intervals, upper], axis=1).ravel()
        padded = np.append(by_place, np.iinfo(np.int64).max)
        earliest[full] = np.minimum.reduceat(padded, bounds)[::2][back]
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), by_rank.take(pa.array(earliest - 1)).cast(kind)
    )
    return pa.table([units.column("route"), units.column("text_hash"), units.column("last"), lists], names=names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, hot: int = HOT, shard: int = SHARD):
    """(candidates, removed): the rows with a shared anchor as id_, digest_, text_, shared; and for
    each id_, digest_ the first words (from 0) of its windows that an earlier document also has."""
    rows = docs.select(
        F.col(id_col).alias("id_"), F.xxhash64(text_col).alias("digest_"), F.col(text_col).alias("text_")
    )
    kind = rows.schema["id_"].dataType.simpleString()
    candidates = _candidates(rows, window, hot)
    units = c.write_rows(
        _segments(candidates, window, with_text=True).groupBy("route", "text_hash").agg(
            F.min("id_").alias("least"), F.max("id_").alias("last"), F.first("segment").alias("segment")
        ),
        "segments",
    )
    shards = max(1, -(-units.count() // shard))
    dealt = units.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        return _search(table, window, table.schema.field("least").type)

    found = dealt.groupBy("shard").applyInArrow(search, f"route long, text_hash long, last {kind}, earliest array<{kind}>")
    # Segments of which some member comes after an earlier document; the others lose nothing.
    later = F.exists("earliest", lambda x: x < F.col("last"))
    found = c.write_rows(found.filter(later).select("route", "text_hash", "earliest"), "earliest")
    members = _segments(candidates, window, with_text=False).join(found, ["route", "text_hash"])
    later = F.filter(
        F.transform("earliest", lambda x, i: F.when(x < F.col("id_"), F.col("first") + i)), lambda x: x.isNotNull()
    )
    own = members.withColumn("firsts", later).filter(F.size("firsts") > 0)
    removed = own.groupBy("id_", "digest_").agg(F.array_distinct(F.flatten(F.collect_list("firsts"))).alias("firsts"))
    return candidates, c.write_rows(removed, "repeats")


def _candidates(rows: DataFrame, window: int, hot: int) -> DataFrame:
    anchors = _anchors(rows, window)
    shared = (
        anchors.groupBy("anchor")
        .agg(F.min("id_").alias("least"), F.max("id_").alias("last"), F.count("*").alias("n"))
        .filter(F.col("least") < F.col("last"))
        .select("anchor", (F.col("n") > hot).alias("hot"))
    )
    shared = c.write_rows(shared, "shared-anchors")
    by_doc = anchors.join(shared, "anchor").groupBy("id_").agg(F.collect_set(F.struct("anchor", "hot")).alias("shared"))
    by_doc = c.write_rows(by_doc, "anchors-by-document")
    return c.write_rows(rows.join(by_doc, "id_"), "candidates")


def _kept(text: bytes, firsts, window: int) -> tuple[int, int, bytes]:
    """Words of a text, how many of them are removed, and the others joined by spaces."""
    words = text.split()  # bytes: ASCII white space only
    if not firsts:
        return len(words), 0, b" ".join(words)
    gone = c.cover(np.asarray(firsts, dtype=np.int64), window, len(words))
    return len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and, if asked, kept (the words left, joined by spaces)."""
    candidates, removed = repeats(docs, id_col, text_col, window)
    out = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def result(rows: DataFrame) -> DataFrame:
        kind = rows.schema["id_"].dataType.simpleString()
        at = rows.columns.index("firsts") if "firsts" in rows.columns else -1

        def scan(batches):
            for batch in batches:
                for part, data, offsets in c.slices(batch, "text_"):
                    raw, bounds = data.tobytes(), offsets.tolist()
                    firsts = part.column(at).to_pylist() if at >= 0 else [None] * part.num_rows
                    done = [_kept(raw[bounds[k] : bounds[k + 1]], firsts[k], window) for k in range(part.num_rows)]
                    columns = [
                        part.column(0),
                        part.column(1),
                        pa.array([x[0] for x in done], pa.int64()),
                        pa.array([x[1] for x in done], pa.int64()),
                        pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()),
                    ]
                    if with_text:
                        columns.append(pa.array([x[2] for x in done], pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, ["id_", "digest_", *out])

        return rows.mapInArrow(scan, f"id_ {kind}, digest_ long, {kinds}")

    rows = docs.select(F.col(id_col).alias("id_"), F.xxhash64(text_col).alias("digest_"), F.col(text_col).alias("text_"))
    keys = ["id_", "digest_"]
    changed = result(candidates.select(*keys, "text_").join(removed, keys).select(*keys, "text_", "firsts"))
    changed = changed.dropDuplicates(keys).select(F.col("id_").alias("i"), F.col("digest_").alias("d"), *[F.col(x).alias(f"new_{x}") for x in out])
    whole = result(rows)
    joined = whole.join(changed, (F.col("id_") == F.col("i")) & (F.col("digest_") == F.col("d")), "left")
    return joined.select(F.col("id_").alias(id_col), *[F.coalesce(f"new_{x}", x).alias(x) for x in out])
