"""Source divergence audit: exact term shares of every source within its language.

1. Frequency filtering: each task adds up in how many documents of a language a term stands, and
   the terms in at least ``min_docs`` of them are kept. Counts are exact.
2. The kept terms of a language are dealt by hash into shards of about ``SHARD_KEYS``; a task per
   shard builds its minimal perfect hash (``perfect_hash``), stored with its keys.
3. Recount: the shards are broadcast, at most ``ROUND_BYTES`` of them at a time, each round being
   one pass over the texts. A task looks every word up, compares it with the stored key, and
   increments the slots of a dense counter array per (lang, source); when its arrays hold
   ``DENSE_SLOTS`` slots, the counts above zero are passed on and the arrays start anew.
4. Sums by (lang, source, slot) give p; f of all terms is added up for pairs of sources, shard by
   shard as dense matrices over blocks of at most about ``BLOCK`` sources, so no task holds a
   language's sources or terms whole.

Terms are runs of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]` with A-Z lower-cased. A null text, lang or
source is ''. Every row is a document of its own, also one that repeats another or has no id. A
group without terms, and a language without kept terms, still take part: all pairs of sources of
its language are compared (0 where nothing is kept). An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm.distinct import Counter, batches, distinct
from spinecat.llm.perfect_hash import Shards, build
from spinecat.operators.joins import join_unique

MIN_DOCS = 30
TOP = 50
#: p is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)); SCALE is STEP to the third power.
STEP, SMOOTH = 1000, 5
SHARD_KEYS = 4_096
ROUND_BYTES = 32_000_000
DENSE_SLOTS = 4_000_000
BLOCK = 256

NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _codes(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Each row's number among the distinct values of some columns, and these values."""
    seen: dict = {}
    rows = zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names))
    codes = np.array([seen.setdefault(x, len(seen)) for x in rows], dtype=np.int64)
    return codes, list(seen)


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(rows, lower-cased bytes, starts, ends, row of each term) of the slices of a batch."""
    for rows, data, offsets in c.slices(batch, "text"):
        low = c.LOWER[data]
        yield rows, low, *c.word_spans(low, offsets, NOT_LETTER)


def _document_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: dict):
        langs, terms = [k[0] for k in found], [k[1].decode() for k in found]
        return batches({"lang": (langs, pa.string()), "term": (terms, pa.string()), "n": (list(found.values()), pa.int64())})

    counts = Counter()
    for batch in stream:
        for rows, data, starts, ends, row in _words(batch):
            code, langs = _codes(rows, ["lang"])
            hashes = c.word_hashes(data, starts, ends)
            once, _ = distinct(data, starts, ends, row, hashes)
            starts, ends, group = starts[once], ends[once], code[row[once]]
            first, inverse = distinct(data, starts, ends, group, hashes[once])
            raw = data.tobytes()
            places = zip(group[first].tolist(), starts[first].tolist(), ends[first].tolist())
            keys = [(langs[g][0], raw[a:b]) for g, a, b in places]
            counts.add(keys, np.bincount(inverse, minlength=len(first)).tolist())
            if counts.full:
                yield from out(counts.taken())
    yield from out(counts.taken())


def _key_hashes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash by which terms are dealt and placed."""
    for batch in stream:
        for rows, data, offsets in c.slices(batch, "term"):
            hashes = c.word_hashes(data, offsets[:-1], offsets[1:])
            yield pa.record_batch([*rows.columns, pa.array(hashes.view(np.int64))], names=["lang", "term", "h"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and hash h of the terms in at least ``min_docs`` documents of a language."""
    partial = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    counted = partial.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= min_docs).select("lang", "term")
    return kept.mapInArrow(_key_hashes, "lang string, term string, h long")


def _shard_of(hashed: Column, shards: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 40), shards).cast("int")


def _built(keys: pd.DataFrame) -> pd.DataFrame:
    terms = np.array([x.encode() for x in keys["term"]], dtype=object)
    sizes, words, slots = build(keys["h"].to_numpy().view(np.uint64))
    in_order = np.empty(len(terms), dtype=object)
    in_order[slots] = terms
    row = {
        "lang": keys["lang"].iloc[0],
        "shard": keys["shard"].iloc[0],
        "shards": keys["shards"].iloc[0],
        "sizes": sizes.tobytes(),
        "words": words.tobytes(),
        "terms": [x.decode() for x in in_order],
        "bytes": sum(map(len, terms)) + 2 * words.nbytes + 16 * len(terms),
    }
    return pd.DataFrame([row])


SHARD_ROW = "lang string, shard int, shards int, sizes binary, words binary, terms array<string>, bytes long"


def perfect_shards(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard: its perfect hash and its terms in slot order."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / shard_keys).cast("int").alias("shards"))
    dealt = join_unique(kept, sizes, ["lang"]).withColumn("shard", _shard_of(F.col("h"), F.col("shards")))
    return dealt.groupBy("lang", "shard").applyInPandas(_built, SHARD_ROW)


def _rounds(shards: DataFrame, limit: int) -> list[list[tuple[str, int]]]:
    """Shards of each pass over the texts, those of a language together."""
    rounds, held = [], 0
    for row in shards.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():
        if not rounds or held + row["bytes"] > limit:
            rounds.append([])
            held = 0
        rounds[-1].append((row["lang"], row["shard"]))
        held += row["bytes"]
    return rounds


class Round:
    """The shards of one pass, as a task uses them."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        parts = [
            (np.frombuffer(r[3], dtype=np.int64), np.frombuffer(r[4], dtype=np.uint64), [t.encode() for t in r[5]]) for r in rows
        ]
        self.keys = Shards(parts)
        #: Of each language: its shards in all, the first one here, its place, and the end of its last.
        self.langs = {}
        ends = {r[0]: i + 1 for i, r in enumerate(rows)}
        for place, (lang, shard, shards, *_) in enumerate(rows):
            self.langs.setdefault(lang, (shards, shard, place, ends[lang]))

    def range(self, lang: str) -> tuple[int, int]:
        """Slots of a language."""
        _, _, place, end = self.langs[lang]
        return int(self.keys.base[place]), int(self.keys.base[end])

    def shards(self, hashes: np.ndarray, codes: np.ndarray, langs: list[str]) -> np.ndarray:
        """Place of each word's shard, -1 where this pass does not have it."""
        size, first, place, end = np.array([self.langs.get(x, (1, 0, 0, 0)) for x in langs], dtype=np.int64).reshape(-1, 4).T
        at = (hashes >> np.uint64(40)).astype(np.int64) % size[codes] - first[codes] + place[codes]
        return np.where((at >= place[codes]) & (at < end[codes]), at, -1)


_LOADED: dict = {}


def _loaded(shared: Broadcast) -> Round:
    """The round of a broadcast, decoded once per Python worker."""
    if shared.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value[0]] = Round(shared.value[1])
    return _LOADED[shared.value[0]]


COUNTED = "lang string, source string, shard int, slot int, n long"


def _recount(shared: Broadcast, dense_slots: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shared)
        dense: dict = {}

        def out():
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                slot = at + own.range(lang)[0]
                place = np.searchsorted(own.keys.base, slot, side="right") - 1
                shard = np.array([r[1] for r in own.rows])[place]
                yield from batches(
                    {
                        "lang": ([lang] * len(at), pa.string()),
                        "source": ([source] * len(at), pa.string()),
                        "shard": (shard, pa.int32()),
                        "slot": (slot - own.keys.base[place], pa.int32()),
                        "n": (counts[at], pa.int64()),
                    }
                )
            dense.clear()

        held = 0
        for batch in stream:
            for rows, data, starts, ends, row in _words(batch):
                code, groups = _codes(rows, ["lang", "source"])
                group = code[row]
                hashes = c.word_hashes(data, starts, ends)
                shard = own.shards(hashes, group, [g[0] for g in groups])
                slots = own.keys.slots(hashes, shard, data, starts, ends)
                group, slots = group[slots >= 0], slots[slots >= 0]
                found, n = np.unique(group * own.keys.base[-1] + slots, return_counts=True)
                group, slots = np.divmod(found, max(int(own.keys.base[-1]), 1))
                for g in np.unique(group).tolist():
                    first, end = own.range(groups[g][0])
                    if groups[g] not in dense:
                        if dense and held + end - first > dense_slots:
                            yield from out()
                            held = 0
                        dense[groups[g]] = np.zeros(end - first, dtype=np.int64)
                        held += end - first
                    a, b = np.searchsorted(group, [g, g + 1])
                    dense[groups[g]][slots[a:b] - first] += n[a:b]
        yield from out()

    return run


def recount(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES, dense_slots: int = DENSE_SLOTS) -> DataFrame:
    """Occurrences of every kept term in every (lang, source) that has it, by shard and slot."""
    spark = docs.sparkSession
    texts = docs.select("lang", "source", "text")
    passes = []
    for chosen in _rounds(shards, round_bytes):
        low, high = chosen[0], chosen[-1]
        # The shards of a pass are a range of (lang, shard).
        after = (F.col("lang") > low[0]) | ((F.col("lang") == low[0]) & (F.col("shard") >= low[1]))
        until = (F.col("lang") < high[0]) | ((F.col("lang") == high[0]) & (F.col("shard") <= high[1]))
        rows = sorted((tuple(r) for r in shards.filter(after & until).collect()), key=lambda r: (r[0].encode(), r[1]))
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        partial = texts.mapInArrow(_recount(shared, dense_slots), COUNTED)
        summed = partial.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        passes.append(c.write_rows(summed, "term-counts"))
        shared.unpersist()
    if not passes:
        return spark.createDataFrame([], COUNTED)
    counts = passes[0]
    for part in passes[1:]:
        counts = counts.unionByName(part)
    return counts


def share(count: Column, total: Column) -> Column:
    """1 + floor(STEP^3 * count / total) by long division, which stays within 64 bits."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * STEP
        out = out * STEP + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def _pair_sums(cell: pa.Table) -> pa.Table:
    """Sums of |p - p'| over one shard, for the pairs of sources of two blocks.

    A row with a slot gives p there; a row without gives a source's p everywhere else.
    """
    rows = cell.to_pandas()
    head = rows[rows["slot"] < 0].sort_values("source", ignore_index=True)
    names = head["source"].to_numpy(dtype=object)
    number = pd.Series(np.arange(len(names)), index=names)
    p = np.repeat(head["p"].to_numpy(np.int64)[:, None], int(head["keys"].iloc[0]) if len(head) else 0, axis=1)
    body = rows[rows["slot"] >= 0]
    p[number[body["source"]].to_numpy(), body["slot"].to_numpy()] = body["p"].to_numpy(np.int64)
    left, right = rows["left"].iloc[0], rows["right"].iloc[0]
    block = head["block"].to_numpy()
    firsts, seconds, values = [], [], []
    for i in np.flatnonzero(block == left):
        others = np.flatnonzero(block == right)
        others = others[others > i] if left == right else others
        firsts += [names[i]] * len(others)
        seconds += names[others].tolist()
        values += np.abs(p[others] - p[i]).sum(axis=1).tolist()
    langs = [rows["lang"].iloc[0]] * len(values)
    columns = [pa.array(x, type=pa.string()) for x in (langs, firsts, seconds)]
    return pa.table([*columns, pa.array(values, type=pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: distances of sources, and each source's telling terms."""
    texts = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("text", "lang", "source")))
    shards = c.write_rows(perfect_shards(kept_terms(texts, min_docs), shard_keys), "term-shards")
    counts = recount(texts, shards)

    sizes = shards.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.max("shards").alias("shards"))
    sources = texts.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = join_unique(join_unique(sources, totals, ["lang", "source"]), sizes, ["lang"])
    groups = groups.fillna(0, ["total", "v", "shards"])
    per_lang = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.ceil(F.count("*") / block).cast("int").alias("blocks")
    )
    groups = c.write_rows(
        join_unique(groups, per_lang, ["lang"]).withColumn("divisor", F.col("total") + SMOOTH * F.col("v")), "term-groups"
    )

    known = join_unique(counts, groups, ["lang", "source"])
    known = known.withColumn("p", share(F.col("n") + SMOOTH, F.col("divisor")))

    terms = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
    slots = ["lang", "shard", "slot"]
    whole = join_unique(counts.groupBy(*slots).agg(F.sum("n").alias("lang_n")), terms, slots)
    q = share(F.col("lang_n") + SMOOTH, F.col("lang_total") + SMOOTH * F.col("v"))
    above = join_unique(known, whole, slots).withColumn("value", F.col("p") - q).filter("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best))
    term_part = ranked.filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # Every source goes to all cells of its block's row and column in the grid of block pairs.
    placed = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    cell = F.struct(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    columns = ["lang", "shard", "left", "right", "block", "source", "slot", "p", "keys"]

    def in_cells(rows: DataFrame) -> DataFrame:
        wide = rows.withColumn("block", placed)
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return wide.withColumn("cell", cell).select(*columns[:2], "cell.left", "cell.right", *columns[4:])

    everywhere = groups.filter("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    held = shards.select("lang", "shard", F.size("terms").alias("keys"))
    everywhere = join_unique(everywhere, held, ["lang", "shard"], "inner")
    everywhere = everywhere.withColumn("p", share(F.lit(SMOOTH).cast("long"), F.col("divisor"))).withColumn("slot", F.lit(-1))
    grid = in_cells(everywhere).unionByName(in_cells(known.withColumn("keys", F.lit(0))))
    partial = grid.groupBy("lang", "shard", "left", "right").applyInArrow(_pair_sums, "lang string, a string, b string, value long")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Sources of a language without terms differ by nothing.
    bare = groups.filter("shards = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both.unionByName(none).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_part.select(*columns).unionByName(term_part.select(*columns))
