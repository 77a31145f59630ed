"""SimHash near-duplicates, linked by pigeonring filtering.

A fingerprint has a bit where over half of the text's shingle hashes have it. Two fingerprints
link at ``LIMIT`` = 4 or fewer differing bits. The 64 bits lie on a ring of five segments. If two
fingerprints differ in at most 4 bits, some segment starts a chain whose cumulative differences
stay within the proportional budgets: over its first k segments at most floor(4k/5) bits differ,
for every k. So its first segment is equal and the first two differ in at most one bit. That
prefix is the index key: (ring position, first segment, second segment), stored once per
position, and looked up with the second segment as it is and with each of its set bits cleared
(of two values that differ in one bit, one has the bit set). The rest of the chain is checked
before the full Hamming distance.

Equal fingerprints collapse first, so copies cost one row. Every key's entries and look-ups meet
in one sorted run; within a run only a spanning forest of the links goes out, not all pairs. A
key with more than ``HOT`` entries is dealt out as a grid of blocks, each pair of blocks being a
run of its own, so a large group of near copies is compared in full by many tasks. Components of
the links are found by alternating large-star and small-star rounds with reliable checkpoints.

Null and empty texts have the fingerprint zero, which links like any other. Repeated ids are kept
row by row; a null id never names a component unless all its members are null. An empty table
gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c

LIMIT = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Bits that may differ over the first k segments of a chain.
BUDGET = tuple(LIMIT * k // len(WIDTHS) for k in range(1, len(WIDTHS) + 1))
HOT = 1024


def fingerprint(text: bytes, size: int) -> int:
    """Unsigned fingerprint of a text's ``size``-word shingles, A-Z lower-cased."""
    words = text.lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    lasts = ends[-n:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        pairs = zip(starts[at : at + 65_536][: n - at].tolist(), lasts[at : at + 65_536].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * total[k] > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, keep=()) -> DataFrame:
    """Columns id_, fp_ (the 64 bits as a signed long) and those of ``keep``, by their own names."""
    picked = docs.select(
        F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), *[F.col(k).alias(f"k{i}_") for i, k in enumerate(keep)]
    )
    out = ["id_", *(f"k{i}_" for i in range(len(keep)))]

    def scan(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            values = np.array([fingerprint(t.as_py(), size) for t in texts], dtype=np.uint64).astype(np.int64)
            columns = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], [*out, "fp_"])

    schema = ", ".join(f"{k} {picked.schema[k].dataType.simpleString()}" for k in out)
    return picked.mapInArrow(scan, f"{schema}, fp_ long").select(
        "id_", "fp_", *[F.col(f"k{i}_").alias(k) for i, k in enumerate(keep)]
    )


def _entries(fp: np.ndarray):
    """Index keys and look-up keys (key, fingerprint) of unsigned fingerprints."""
    index_keys, probe_keys, probe_fps = [], [], []
    segments = [(fp >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(STARTS, WIDTHS, strict=True)]
    for ring in range(len(WIDTHS)):
        then = (ring + 1) % len(WIDTHS)
        head = (np.uint64(ring) << np.uint64(26)) | (segments[ring] << np.uint64(13))
        index_keys.append(head | segments[then])
        for bit in range(WIDTHS[then]):
            has = (segments[then] >> np.uint64(bit)) & np.uint64(1) == 1
            probe_keys.append(head[has] | (segments[then][has] ^ np.uint64(1 << bit)))
            probe_fps.append(fp[has])
    return np.concatenate(index_keys), np.concatenate(probe_keys), np.concatenate(probe_fps)


def _keyed(distinct: DataFrame) -> DataFrame:
    """(key, fp, probe) rows: five entries and about 32 look-ups a fingerprint."""

    def scan(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                index, probe, who = _entries(part)
                keys = np.concatenate([index, probe]).astype(np.int64)
                fps = np.concatenate([np.tile(part, len(WIDTHS)), who]).view(np.int64)
                flags = np.arange(len(keys)) >= len(index)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps), pa.array(flags)], ["key", "fp", "probe"])

    return distinct.mapInArrow(scan, "key long, fp long, probe boolean")


#: Bits of the first k + 1 segments of the chain from each ring position.
MASKS = np.array(
    [
        [sum(((1 << WIDTHS[j]) - 1) << STARTS[j] for j in ((r + i) % len(WIDTHS) for i in range(k + 1))) for k in range(len(WIDTHS))]
        for r in range(len(WIDTHS))
    ],
    dtype=np.uint64,
)


def _links(a: np.ndarray, b: np.ndarray, ring):
    """Pairs whose chain from ``ring`` keeps its budgets; the last one is the full distance."""
    x, where = a ^ b, np.arange(len(a))
    for k, most in enumerate(BUDGET):
        ok = np.bitwise_count(x & MASKS[ring, k]) <= most
        x, where = x[ok], where[ok]
        ring = ring[ok] if isinstance(ring, np.ndarray) else ring
    return a[where], b[where]


def _forest(a: np.ndarray, b: np.ndarray):
    """Member and least member of every component of the links of one run."""
    members, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    label = np.arange(len(members))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(members))
    return members[other], members[label[other]]


def _run_links(keys: np.ndarray, groups: np.ndarray, fps: np.ndarray, probe: np.ndarray):
    """Links of complete runs: rows sorted by group, entries before look-ups within each."""
    n = len(groups)
    new = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    bounds = np.concatenate([[0], new, [n]])
    sizes = np.diff(bounds)
    entries = np.add.reduceat(~probe, bounds[:-1]).astype(np.int64)
    some = (entries > 0) & (sizes > 1)
    out_a, out_b = [], []
    small = some & (sizes <= 16)
    at, size, own = bounds[:-1][small], sizes[small], entries[small]
    for i in range(int(own.max(initial=0))):  # entry i of each small run against all rows after it
        for j in range(i + 1, 16):
            take = (own > i) & (size > j)
            if not take.any():
                break
            x, y = at[take] + i, at[take] + j
            a, b = _links(fps[x], fps[y], keys[x] >> 26)
            out_a.append(a)
            out_b.append(b)
    for k in np.flatnonzero(some & (sizes > 16)).tolist():
        lo, mid, hi = bounds[k], bounds[k] + entries[k], bounds[k + 1]
        a_, b_ = [], []
        for x in range(lo, mid):
            later = fps[x + 1 : hi]
            a, b = _links(np.full(len(later), fps[x]), later, int(keys[x] >> 26))
            a_.append(a)
            b_.append(b)
        a, b = _forest(np.concatenate(a_), np.concatenate(b_))
        out_a.append(a)
        out_b.append(b)
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.uint64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)
    return a, b


def _matches(batches):
    """Links from rows sorted by (key, left, right, probe); a run may go over several batches."""
    held = None
    names = ("key", "left", "right", "fp", "probe")
    for batch in batches:
        now = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        done, held = [x[:cut] for x in held], [x[cut:] for x in held]
        yield from _emit(done)
    if held is not None:
        yield from _emit(held)


def _emit(rows):
    key, left, right, fp, probe = rows
    if not len(key):
        return
    change = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    groups = np.concatenate([[0], np.cumsum(change)])
    a, b = _run_links(key, groups, fp.view(np.uint64), probe.astype(bool))
    if len(a):
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) of distinct fingerprints: they connect all that are within LIMIT bits."""
    keyed = _keyed(distinct)
    counts = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("probe").alias("only_probes"))
    heavy = counts.filter(~F.col("only_probes") & (F.col("rows") > hot)).select(
        "key", F.ceil(F.col("rows") / hot).cast("int").alias("blocks")
    )
    rows = keyed.join(heavy, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Entries meet look-ups of every block, and entries of their own and of later blocks as entries.
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), "probe")))
    as_entry = F.transform(every, lambda x: F.struct(own.alias("left"), x.alias("right"), F.lit(False).alias("probe")))
    as_other = F.transform(every, lambda x: F.struct(x.alias("left"), own.alias("right"), F.lit(True).alias("probe")))
    cells = cells.when(F.col("probe"), as_other).otherwise(
        F.concat(as_entry, F.filter(as_other, lambda x: x["left"] < own))
    )
    dealt = rows.select("key", "fp", F.explode(cells).alias("cell")).select(
        "key", F.col("cell.left").alias("left"), F.col("cell.right").alias("right"), "fp", F.col("cell.probe").alias("probe")
    )
    sorted_ = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "probe")
    return sorted_.mapInArrow(_matches, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b) other than its component's least.

    Alternating large-star and small-star rounds: each links a node's neighbours to its least one,
    first the larger neighbours, then the smaller. The work is joins and grouped minima on the
    node, and the number of rounds grows with the logarithm of a component's length.
    """
    spark = edges.sparkSession
    now = c.write_rows(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # The least neighbour of a stays linked to a; the others are linked to it.
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = c.write_rows(small.distinct(), "edges")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components not settled after {rounds} rounds on {spark.sparkContext.applicationId}")


def classes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows of ``fingerprints`` with component_, the least id reachable over links, and root_.

    Components can share component_ (null, or an id that stands at unlike texts), never root_.
    """
    distinct = c.write_rows(prints.groupBy("fp_").agg(F.min("id_").alias("least_")), "fingerprints")
    roots = components(links(distinct.select(F.col("fp_").alias("fp")), hot))
    rooted = distinct.join(roots, F.col("fp_") == F.col("node"), "left").select(
        "fp_", "least_", F.coalesce("root", "fp_").alias("root_")
    )
    # Fingerprints that no link reaches are their own component; only linked ones are grouped.
    whole = rooted.groupBy("root_").agg(F.min("least_").alias("component_"))
    named = rooted.join(whole, "root_").select(F.col("fp_").alias("fp2_"), "component_", "root_")
    return prints.join(named, F.col("fp_") == F.col("fp2_")).drop("fp2_")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every document."""
    prints = c.write_rows(fingerprints(docs, id_col, text_col, size), "prints")
    return classes(prints).select(
        F.col("id_").alias(id_col),
        F.lower(F.lpad(F.hex("fp_"), 16, "0")).alias("fingerprint"),
        F.col("component_").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """All columns of the one document of each component with the least id (then least text)."""
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    flat = docs.toDF(*names.values())
    prints = c.write_rows(fingerprints(flat, names[id_col], names[text_col], size, keep=list(names.values())), "prints")
    named = classes(prints.select("id_", "fp_", *names.values()))
    kept = named.filter(F.col("id_").eqNullSafe(F.col("component_")))
    # Rows that share the least id combine before the shuffle: a large component sends one row a task.
    order = dict.fromkeys([names[text_col], *names.values()])
    least = kept.groupBy("root_").agg(F.min(F.struct(*order)).alias("row_"))
    return least.select(*[F.col("row_").getField(v).alias(k) for k, v in names.items()])
