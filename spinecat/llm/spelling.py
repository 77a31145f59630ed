"""Spelling variants: words of the corpus at one edit from each other, and the form they vary.

Counting. Words are runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased. Each occurrence is hashed
with its document's id (crc32 of `<doc_id>:<run>`); where ``SLIP`` divides the hash, one code point
is left out of it. Tasks add up occurrences by word, then Spark does; words of ``MIN_LENGTH`` code
points and ``MIN_COUNT`` occurrences stay.

Join by asymmetric q-chunks. Of two words at one edit, the longer one (either, if they are equally
long) is cut into two disjoint chunks. The edit spares one of them, and the other word has that
chunk as the gram at the same place, or shifted by one if it is shorter. So a word of length L
contributes its two chunks, and as the shorter partner its grams at both places that a word of L + 1
allows. A shared chunk is a key; the open rest, [low, high) of the longer word, holds the edit.

Keys with more than ``CROWD`` words are cut again by the same step: the open rest is halved, and a
half that the edit spares joins the key. At the last step the open rest is one code point, and only
words that differ there share the key, no more than the alphabet has letters; so no key lists more
than a bounded number of pairs, however frequent its chunk is. Keys carry a hash of their chunks;
candidates are verified by their edit distance, and a pair that several keys find counts once: under
the key whose open rest holds its first differing code point.

A word's form is its near word of the largest count, if that is ``LEAD`` times its own or more;
forms of forms are followed by pointer doubling, as every step multiplies the count.

A null text is empty, a null id is the empty string in the hash; repeated rows and ids count as
often as they stand. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm.distinct import Counter, batches, distinct
from spinecat.operators.joins import join_unique

SLIP = 199
MIN_LENGTH, MIN_COUNT, LEAD = 6, 5, 5
CROWD = 64
#: Longer runs are hashed by zlib one by one.
LONG_RUN = 64

#: Bytes that are no part of a word, once the two-byte letters have been told apart.
GAP = np.zeros(256, dtype=bool)
GAP[0] = True
ASCII = np.zeros(256, dtype=bool)
ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def crc_table() -> np.ndarray:
    """CRC-32 of each single byte, by the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


_CRC = crc_table()


def crc_from(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each string, continued from the crc32 of what stands before it."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    lengths = ends - starts
    todo = np.flatnonzero(lengths <= LONG_RUN)
    for k in range(LONG_RUN):
        todo = todo[lengths[todo] > k]
        if not len(todo):
            break
        at = (out[todo] ^ data[starts[todo] + k]) & np.uint32(0xFF)
        out[todo] = _CRC[at] ^ (out[todo] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG_RUN).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(state[i]))
    return out


def runs(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes with 0 between the runs, and byte starts, byte ends and row of the runs."""
    lead = data == 0xC3
    letters = ASCII[data] | lead
    letters[1:] |= lead[:-1]
    low = np.where(letters, c.LOWER[data], 0).astype(np.uint8)
    return low, *c.word_spans(low, offsets, GAP)


def _counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: dict):
        words = [k.decode() for k in found]
        return batches({"word": (words, pa.string()), "n": (list(found.values()), pa.int64())})

    counts = Counter()
    for batch in stream:
        for rows, data, offsets in c.slices(batch, "text"):
            low, starts, ends, row = runs(data, offsets)
            points = c.code_points(low)
            long = points[ends] - points[starts] >= MIN_LENGTH
            starts, ends, row = starts[long], ends[long], row[long]
            ids = rows.column(rows.schema.get_field_index("ident")).to_pylist()
            prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], dtype=np.uint32)
            hashed = crc_from(prefix[row], low, starts, ends)
            slip = hashed % np.uint32(SLIP) == 0
            raw = low.tobytes()
            for h, a, b in zip(hashed[slip].tolist(), starts[slip].tolist(), ends[slip].tolist()):
                run = raw[a:b].decode()
                at = h % len(run)
                word = run[:at] + run[at + 1 :]
                if len(word) >= MIN_LENGTH:
                    counts.add([word.encode()], [1])
            starts, ends = starts[~slip], ends[~slip]
            first, inverse = distinct(low, starts, ends, np.zeros(len(starts), dtype=np.int64))
            keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            counts.add(keys, np.bincount(inverse, minlength=len(first)).tolist())
            if counts.full:
                yield from out(counts.taken())
    yield from out(counts.taken())


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """word and its occurrences n."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident")
    texts = docs.select(ident, F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _key(shift: int | Column) -> Column:
    """Hash of what a word has outside the open rest, which ends ``shift`` code points earlier in it."""
    tail = F.col("word").substr(F.col("high") + 1 - shift, F.col("size"))
    return F.xxhash64("size", "low", "high", F.substring("word", F.lit(1), F.col("low")), tail)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key(F.col("shift")))


def _first_keys(counted: DataFrame) -> DataFrame:
    """Every word as the longer or equally long partner (shift 0) and as the shorter one (shift 1)."""
    length = F.char_length("word")
    roles = F.array(*[F.struct(F.lit(s).alias("shift"), (length + s).alias("size")) for s in (0, 1)])
    rows = counted.withColumn("role", F.explode(roles)).select("word", "n", "role.*")
    half = F.floor(F.col("size") / 2).cast("int")
    rests = F.array(
        F.struct(half.alias("low"), F.col("size").alias("high")), F.struct(F.lit(0).alias("low"), half.alias("high"))
    )
    return _keyed(rows.withColumn("rest", F.explode(rests)).select("word", "n", "shift", "size", "rest.*"))


def _halved(rows: DataFrame) -> DataFrame:
    """The keys of a crowd, each with one half of its open rest more."""
    half = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    rests = F.array(
        F.struct(half.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), half.alias("high"))
    )
    rows = rows.withColumn("rest", F.explode(rests)).select("word", "n", "shift", "size", "rest.*")
    return _keyed(rows)


def _pairs(rows: DataFrame) -> DataFrame:
    """Verified pairs of words that share a key: the longer or lesser word first."""
    place = ["key", "size", "low", "high"]
    left = rows.filter("shift = 0").select(*place, F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select(*place, "shift", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, place).filter((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    near = F.levenshtein("a", "b", 1) == 1
    # The first difference lies in the open rest: before it the words agree, up to its end they do not.
    here = F.substring("a", F.lit(1), F.col("high")) != F.substring("b", F.lit(1), F.col("high"))
    return met.filter(near & here).select("a", "a_n", "b", "b_n")


def near_words(counted: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of words at one edit, each once."""
    rows, found = _first_keys(counted), []
    while True:
        place = ["key", "size", "low", "high"]
        crowds = rows.groupBy(*place).agg(F.count("*").alias("m"), F.count_if(F.col("shift") == 0).alias("m0"))
        # Keys without two words, or without a longer one, have no pair.
        crowds = crowds.filter("m0 > 0 AND m > 1").withColumn("crowd", (F.col("m") > crowd) & (F.col("high") - F.col("low") > 1))
        marked = c.write_rows(join_unique(rows, crowds.select(*place, "crowd"), place, "inner"), "word-keys")
        found.append(_pairs(marked.filter("NOT crowd")))
        crowded = marked.filter("crowd")
        if crowded.isEmpty():
            break
        rows = _halved(crowded)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def group(counted: DataFrame, lead: int = LEAD, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words."""
    pairs = near_words(counted, crowd)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = counted.join(near, "word", "left")
    leads = -F.col("best.less") >= lead * F.col("n")
    formed = joined.select(
        "word",
        F.when(leads, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, -F.col("best.less")).alias("form_n"),
    )
    formed = c.write_rows(formed, "word-forms")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    rooted = join_unique(formed, roots, ["word"])
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(pointers: DataFrame) -> DataFrame:
    """word and the last word its pointers lead to; each round doubles the steps taken."""
    written = None
    while True:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = join_unique(pointers, onward, ["root"])
        jumped = jumped.select("word", F.coalesce("further", "root").alias("root"), "further")
        written = c.write_rows(jumped, "word-roots", written)
        pointers = written.drop("further")
        if written.filter("further IS NOT NULL").isEmpty():
            return pointers


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of a corpus with their forms and roots."""
    return group(c.write_rows(words(docs, id_col, text_col), "words"))
