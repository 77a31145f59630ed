"""Benchmark decontamination with a generalised suffix automaton over the items' words.

Words are maximal runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. The automaton of
all items is walked along each document's words; the state and the length of the longest match
that ends at a word tell which windows (``window`` consecutive words of an item, or a whole
shorter item) end there. Runs of document words that are all item words are found first with
numpy, by word hash; only runs long enough for a window are walked, with the words themselves.

The items are dealt into parts of at most ``part_words`` words. The automaton of a part is built
on the driver and broadcast, so what a task holds is bounded; every document is walked past every
part. With one part, which is the usual case, no shuffle takes place; with several, the spans of
a document meet by row number.

Null texts have no words. Items without words match nothing; repeated items and ids count as they
stand. Empty tables give no spans. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c

#: Words of benchmark items in one automaton, which takes about a kilobyte a word.
PART_WORDS = 100_000

def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    low = c.LOWER[data]
    starts, ends, _ = c.word_spans(low, np.array([0, len(low)]), c.NOT_ALNUM)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """Generalised suffix automaton over sequences of words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = defaultdict(set)
        whole: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item, words in items:
            last = 0
            for at, word in enumerate(words, 1):
                last = self._extend(last, word)
                if at >= window:
                    ends[last].add(item)
            if 0 < len(words) < window:
                whole[last].append((len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for state in order:
            up = self.link[state]
            if up > 0 and self.length[up] >= window and state in ends:
                ends[up] |= ends[state]
        #: Items with a window whose words belong to the state: those of length up to link < window <= length.
        self.items = {k: tuple(sorted(v)) for k, v in ends.items() if self.length[self.link[k]] < window}
        self.whole = dict(whole)
        #: Nearest state along the links, itself included, that is the end of a short item.
        self.short = [-1] * len(self.link)
        for state in reversed(order):
            self.short[state] = state if state in whole else self.short[self.link[state]]
        words = {w for _, ws in items for w in ws}
        joined = b"".join(words_ := sorted(words))
        bounds = np.cumsum([0, *map(len, words_)])
        self.hashes = np.sort(c.word_hashes(np.frombuffer(joined, dtype=np.uint8), bounds[:-1], bounds[1:]))
        sizes = [min(len(ws), window) for _, ws in items if ws]
        self.least = min(sizes, default=0)

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.link) - 1

    def _extend(self, last: int, word: bytes) -> int:
        there = self.next[last].get(word)
        if there is not None:  # an earlier item already goes this way
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, word, there)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[state] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
        return state

    def _split(self, at: int, word: bytes, there: int) -> int:
        copy = self._new(self.length[at] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def walk(self, words: list[bytes]):
        """(end, length, items) of every window that ends at a word; end is exclusive."""
        state = matched = 0
        nexts, link, length, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            else:
                matched = 0
            if matched >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                yield at, window, self.items[up]
            up = self.short[state]
            while up > 0:
                for size, item in self.whole[up]:
                    if size <= matched:
                        yield at, size, (item,)
                up = self.short[link[up]]


def _hits(automaton: Automaton, data: np.ndarray, offsets: np.ndarray):
    """Words of the slice, and (row, first word, last word, items) of every window found."""
    low = c.LOWER[data]
    starts, ends, rows = c.word_spans(low, offsets, c.NOT_ALNUM)
    found = []
    if automaton.least and len(starts):
        hashes = c.word_hashes(low, starts, ends)
        place = np.minimum(np.searchsorted(automaton.hashes, hashes), len(automaton.hashes) - 1)
        known = automaton.hashes[place] == hashes
        breaks = np.flatnonzero(~known[1:] | ~known[:-1] | (rows[1:] != rows[:-1])) + 1
        bounds = np.concatenate([[0], breaks, [len(known)]])
        long = np.flatnonzero((np.diff(bounds) >= automaton.least) & known[bounds[:-1]])
        raw = low.tobytes() if len(long) else b""
        for a, b in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
            words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            found.extend((int(rows[a]), a + end - size, a + end, items) for end, size, items in automaton.walk(words))
    return starts, ends, rows, found


CHARS = "struct<start:int,end:int>"
SPANS = "struct<start:int,end:int,whole:int>"
RESULT = f"n_words long, spans array<{SPANS}>, chars array<{CHARS}>, items array<string>"


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for a, b, whole in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1:] = max(out[-1][1], b), max(out[-1][2], whole)
        else:
            out.append([a, b, whole])
    return [tuple(x) for x in out]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, part_words: int):
    """Automata over parts of the items; the driver holds one part's items at a time."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator()
    for item, text in rows:
        words = words_of(text)
        if not words:
            continue
        if part and size + len(words) > part_words:
            yield Automaton(part, window)
            part, size = [], 0
        part.append(("" if item is None else item, words))
        size += len(words)
    if part:
        yield Automaton(part, window)


def _scan(docs: DataFrame, text_col: str, keep: list[str], automaton: Automaton | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton or Automaton([], 1))

    def scan(batches):
        automaton = shared.value
        for batch in batches:
            for part, data, offsets in c.slices(batch, text_col):
                starts, ends, rows, found = _hits(automaton, data, offsets)
                n = part.num_rows
                first = np.searchsorted(rows, np.arange(n))
                spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
                for row, a, b, who in found:
                    spans[row].append((a, b, b - a if b - a < automaton.window else 0))
                    items[row].update(who)
                points = c.code_points(data) if found else None
                merged, chars = [], []
                for row in range(n):
                    own = _merged(spans[row])
                    merged.append([{"start": a - int(first[row]), "end": b - int(first[row]), "whole": w} for a, b, w in own])
                    base = points[offsets[row]] if own else 0
                    chars.append(
                        [{"start": int(points[starts[a]] - base), "end": int(points[ends[b - 1]] - base)} for a, b, _ in own]
                    )
                ends_ = [("start", pa.int32()), ("end", pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(k)) for k in keep),
                        pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                        pa.array(merged, pa.list_(pa.struct([*ends_, ("whole", pa.int32())]))),
                        pa.array(chars, pa.list_(pa.struct(ends_))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    [*keep, "n_words", "spans", "chars", "items"],
                )

    kept = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.mapInArrow(scan, kept + RESULT)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    part_words: int = PART_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of docs (all by default) as struct ``row``, with n_words, spans, chars, items.

    spans (word positions) and chars (code points) are the merged runs of hit words, end exclusive;
    whole is the number of words of the longest item shorter than a window that stands in the span
    in full, 0 without one. items are the sorted ids of the items with a window in the text.
    """
    keep = docs.columns if keep is None else keep
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    flat = docs.toDF(*names.values())
    back = F.struct(*[F.col(names[x]).alias(x) for x in keep]).alias("row")
    kept, text = [names[x] for x in keep], names[text_col]
    automata = _parts(benchmark, item_col, item_text_col, window, part_words)
    first = next(automata, None)
    second = next(automata, None) if first else None
    results = ["n_words", "spans", "chars", "items"]
    if second is None:
        needed = flat.select(*dict.fromkeys([*kept, text]))
        return _scan(needed, text, kept, first).select(back, *results)
    flat = c.write_rows(flat.withColumn("n_", F.monotonically_increasing_id()), "decontaminate")
    together = None
    for automaton in chain((first, second), automata):  # written one by one: one automaton at a time
        scanned = c.write_rows(_scan(flat.select("n_", text), text, ["n_"], automaton), "decontaminate-part")
        together = scanned if together is None else together.unionByName(scanned)
    hits = together.groupBy("n_").agg(  # one row per part and document
        F.max("n_words").alias("n_words"),
        _merge_spans(F.flatten(F.collect_list(F.arrays_zip("spans", "chars")))).alias("both_"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    hits = hits.select("n_", "n_words", F.col("both_.spans").alias("spans"), F.col("both_.chars").alias("chars"), "items")
    return flat.join(hits, "n_").select(back, *results)


def _merge_spans(both):
    """Merge (spans, chars) pairs, sorted here, whose words touch, in one pass over the array."""
    empty = F.array().cast(f"array<struct<spans:{SPANS},chars:{CHARS}>>")

    def step(done, x):
        last = F.element_at(done, -1)
        a, b = last["spans"], x["spans"]
        words = F.struct(
            a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), F.greatest(a["whole"], b["whole"]).alias("whole")
        )
        points = F.struct(
            last["chars"]["start"].alias("start"), F.greatest(last["chars"]["end"], x["chars"]["end"]).alias("end")
        )
        grown = F.struct(words.alias("spans"), points.alias("chars"))
        size = F.size(done)
        touches = (size > 0) & (b["start"] <= a["end"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(size - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.array_sort(both), empty, step)


def n_hit():
    """Words in the spans of a row of ``find``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def clean(
    found: DataFrame, text_col: str = "text", max_span: int = 10, max_coverage: float = 0.5, least_item: int = 3
) -> DataFrame:
    """The rows of ``find`` as they were, with contaminated words cut out of the text.

    A span of at least ``max_span`` words, or one that holds a whole item of at least ``least_item``
    words, is removed with its punctuation up to the next word kept as it stands; a document whose
    hit words are more than ``max_coverage`` of its words is dropped. A shorter item, of one or two
    words, is a phrase that any text may use: it counts as hit words, and goes only within such a span.
    """
    columns = found.schema["row"].dataType.names
    rows = found.withColumn("hit_", n_hit()).filter(F.col("hit_") <= max_coverage * F.col("n_words"))
    cut = F.filter(
        F.arrays_zip("chars", "spans"),
        lambda x: (x["spans"]["end"] - x["spans"]["start"] >= max_span) | (x["spans"]["whole"] >= least_item),
    )
    whole = F.col("row").getField(text_col)
    state = F.aggregate(
        cut,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["done"], F.substr(whole, acc["at"] + 1, x["chars"]["start"] - acc["at"])).alias("done"),
            x["chars"]["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(whole, acc["at"] + 1, F.length(whole))),
    )
    text = F.when(F.size(cut) == 0, whole).otherwise(state)
    return rows.select(*[(text if x == text_col else F.col("row").getField(x)).alias(x) for x in columns])


def items_digest():
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)
