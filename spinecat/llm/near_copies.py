"""Near copies by SimHash: pigeonring chains as index keys, chain and distance, exact check.

Two texts link if the sets of their five-word shingles (A-Z lower-cased; a text of fewer words is
one shingle) have a Jaccard similarity of ``SIMILAR`` = 0.8 or more. At that similarity fingerprints
of 64 bits differ in about 10 bits, so one fingerprint gives no selective key for all of these pairs.
Each set has ``RINGS`` fingerprints of differently seeded shingle hashes, each a ring of seven segments:

1. *Index.* The key of a chain is its ring, its start and the first two segments from there. Budgets of
   floor(3 k / 7) bits over the first k segments are 0 for k = 1 and 2, so texts within ``SURE`` = 3 bits
   on any ring share a key for certain. Others share one by chance: 0.27 a ring at similarity 0.8, so 0.98
   over all rings (simulated), more above. Sets of fewer than ``SMALL`` shingles have twice the rings.
2. *Chain and distance.* A pair under one key goes on if the plain fingerprints, whose hashes no key has
   seen, have a chain of bytes within floor(``BITS`` k / 8) over its first k, for every k, up to the whole
   distance of ``BITS`` = 18. That holds 0.99 of the pairs of similarity 0.8 and 0.0003 of all pairs.
3. *Exact check* of the sets (64-bit hashes of the shingles) of every pair that is left and not
   linked already, directly or over others. Only the texts of such pairs are read.

Texts with equal sets collapse to one node first. The rings come in ``PHASES``; a later one only checks
pairs that are not in one component yet. A key of more than ``CROWD`` entries, and a group to check of
more than ``BLOCK`` texts or ``BLOCK_BYTES``, is dealt out as a grid of blocks, so that every pair of it
still meets and no task holds a large group. A run sends out a spanning forest of its links, not the pairs.

Null and empty texts have no shingle; they are one node. Rows that share an id or have none are kept
apart by their text. Of each component the row of the least id (then least text, then the other
columns) stays, one without id only if all are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinecat.llm import common as c
from spinecat.llm.simhash import components

SIMILAR = 0.8
SIZE = 5
#: Segments of a ring: widths, first bits.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
STARTS = (0, 10, 19, 28, 37, 46, 55)
#: Bits within which two texts share a key for certain, whatever the ring.
SURE = 3
RINGS = 12
#: Two different sets of three shingles or fewer are never similar enough; small ones agree less.
LEAST, SMALL = 4, 8
#: Rings of each pass; the last ones are those of small sets.
PHASES = (range(1), range(1, 4), range(4, 2 * RINGS))
CROWD = 4096
BITS = 18
BUDGET = tuple(BITS * k // 8 for k in range(1, 9))
BLOCK = 256
BLOCK_BYTES = 8_000_000

_SEEDS = c.mix(np.arange(1, 2 * RINGS + 1, dtype=np.uint64) * c.ODD)
#: The lowest bit of every byte.
_LANES = np.uint64(0x0101010101010101)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    data = c.LOWER[data]
    starts, ends, rows = c.word_spans(data, offsets, c.SPACES)
    n = len(offsets) - 1
    words = c.word_hashes(data, starts, ends)
    first, hashes = c.window_hashes(words, rows, size)
    owner = rows[first]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    word_bounds = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for k in range(n):
        a, b = int(word_bounds[k]), int(word_bounds[k + 1])
        if 0 < b - a < size:
            out.append(c.run_hashes(words, np.array([a]), np.array([b])))
        else:
            out.append(np.unique(hashes[bounds[k] : bounds[k + 1]]))
    return out


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each set of hashes, none empty: a bit where over half of them have it."""
    starts = np.cumsum(sizes) - sizes
    # Eight counters of a byte each are summed at once, over no more hashes than a byte counts.
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bits = np.empty((len(sizes), 8, 8), dtype=bool)
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits[:, :, bit] = 2 * counts > sizes[:, None]
    return np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Plain fingerprint and ring fingerprints of each set.

    An empty set has the fingerprint zero; one that can be similar to no other set has no ring.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    prints = np.zeros(len(sets), dtype=np.uint64)
    rings = [np.zeros(0, dtype=np.int64)] * len(sets)
    for rows, seeds in (
        (np.flatnonzero((sizes > 0) & (sizes < LEAST)), 0),
        (np.flatnonzero((sizes >= LEAST) & (sizes < SMALL)), 2 * RINGS),
        (np.flatnonzero(sizes >= SMALL), RINGS),
    ):
        if not len(rows):
            continue
        flat = np.concatenate([sets[k] for k in rows.tolist()])
        prints[rows] = majority(flat, sizes[rows])
        if seeds:
            found = np.stack([majority(c.mix(flat ^ seed), sizes[rows]) for seed in _SEEDS[:seeds]], axis=1).view(np.int64)
            for place, row in zip(rows.tolist(), found, strict=True):
                rings[place] = row
    return prints, rings


def sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with node_ (digest of the shingle set), fp_ and rings_."""

    def scan(batches):
        for batch in batches:
            for part, data, offsets in c.slices(batch, text_col):
                sets = shingle_sets(data, offsets)
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
                prints, rings = sketch(sets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(rings, pa.list_(pa.int64()))],
                    [*part.schema.names, "node_", "fp_", "rings_"],
                )

    added = T.StructType().add("node_", T.LongType()).add("fp_", T.LongType()).add("rings_", T.ArrayType(T.LongType()))
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added.fields]))


def chained(x: np.ndarray) -> np.ndarray:
    """Whether the differing bits have a chain of bytes within the budgets."""
    counts = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)).astype(np.int16)
    running = np.concatenate([np.zeros((len(x), 1), np.int16), np.cumsum(np.tile(counts, 2), axis=1, dtype=np.int16)], axis=1)
    alive = np.ones((len(x), 8), dtype=bool)
    for k, most in enumerate(BUDGET, 1):
        alive &= running[:, k : k + 8] - running[:, :8] <= most
    return alive.any(axis=1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sets have the similarity, by whole numbers of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def run_links(nodes: np.ndarray, prints: np.ndarray, roots: np.ndarray, entries: int | None, sets: list) -> tuple[list, list]:
    """Forest of the links of one run: of all pairs, or of the first ``entries`` rows against the others."""
    label = {}

    def find(x):
        while label.get(x, x) != x:
            label[x] = label.get(label[x], label[x])
            x = label[x]
        return x

    sizes = np.array([len(s) for s in sets])
    a, b = [], []
    for i in range(len(nodes) if entries is None else entries):
        later = np.arange(i + 1 if entries is None else entries, len(nodes))
        near = np.minimum(sizes[later], sizes[i]) >= SIMILAR * np.maximum(sizes[later], sizes[i]) - 1e-9
        later = later[near & (roots[later] != roots[i])]
        for j in later[chained(prints[later] ^ prints[i])].tolist() if len(later) else []:
            left, right = find(int(roots[i])), find(int(roots[j]))
            if left != right and similar(sets[i], sets[j]):
                label[max(left, right)] = min(left, right)
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
    return a, b


def _runs(batches):
    """Links from rows sorted by (key, left, right, probe); a run may go over several batches."""
    held: list[tuple] = []
    for batch in batches:
        for part, data, offsets in c.slices(batch, "text_"):
            sets = shingle_sets(data, offsets)
            names = ("key", "left", "right", "node_", "fp_", "root_", "probe")
            columns = [part.column(part.schema.get_field_index(k)).to_pylist() for k in names]
            a, b = [], []
            for *row, shingles in zip(*columns, sets, strict=True):
                if held and held[0][:3] != tuple(row[:3]):
                    _settle(held, a, b)
                    held = []
                held.append((*row, shingles))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    a, b = [], []
    _settle(held, a, b)
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _settle(held: list, a: list, b: list) -> None:
    if len(held) > 1:
        _, left, right, nodes, prints, roots, probe, sets = zip(*held, strict=True)
        fps = np.array(prints, dtype=np.int64).view(np.uint64)
        entries = None if left[0] == right[0] else len(probe) - sum(probe)
        x, y = run_links(np.array(nodes), fps, np.array(roots), entries, sets)
        a.extend(x)
        b.extend(y)


def chain_keys(rings: range) -> Column:
    """Index keys of the fingerprint ``word`` at a place ``ring`` of some rings: one for each start."""

    def segment(k):
        return F.shiftrightunsigned("word", STARTS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))

    n = len(WIDTHS)
    head = (F.col("ring") + rings.start).cast("long") * n
    return F.array(*[(head + k) * (1 << 20) + segment(k) * (1 << 10) + segment((k + 1) % n) for k in range(n)])


def entries(known: DataFrame, rings: range) -> DataFrame:
    """(key, node_, fp_, root_) of some rings of the nodes."""
    words = F.slice("rings_", rings.start + 1, len(rings))
    spread = known.select("node_", "fp_", "root_", F.posexplode(words).alias("ring", "word"))
    return spread.select(F.explode(chain_keys(rings)).alias("key"), "node_", "fp_", "root_")


def close_rows(groups: np.ndarray, prints: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether a row has another one of its group, and of another component, within the chain budgets."""
    hit = np.zeros(len(groups), dtype=bool)
    step, at = 1, np.flatnonzero(groups[1:] == groups[:-1])
    while len(at):
        pairs = at[roots[at] != roots[at + step]]
        pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + step]) <= BITS]
        pairs = pairs[chained(prints[pairs] ^ prints[pairs + step])] if len(pairs) else pairs
        hit[pairs] = hit[pairs + step] = True
        step += 1
        at = at[at + step < len(groups)]
        at = at[groups[at] == groups[at + step]]
    return hit


def _arrays(batches, names: tuple):
    """(columns, whether it is the last) of every batch that has rows."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, False
            before = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in names]
    if before is not None:
        yield before, True


def _close(batches):
    """(group, node) of the close rows of each run of (key, left, right); equal groups have one number."""
    held = None
    names = ("key", "left", "right", "node_", "fp_", "root_")
    for rows, last in _arrays(batches, names):
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        change = np.zeros(len(held[0]), dtype=bool)
        for x in held[:3]:
            change[1:] |= x[1:] != x[:-1]
        # The last run may go on in the next batch.
        cut = len(change) if last else int(np.flatnonzero(change)[-1]) if change.any() else 0
        done, held = [x[:cut] for x in held], [x[cut:] for x in held]
        groups = np.cumsum(change[:cut])
        hit = close_rows(groups, done[4].view(np.uint64), done[5])
        if hit.any():
            nodes, groups = done[3][hit], groups[hit]
            new = np.concatenate([[True], groups[1:] != groups[:-1]])
            sums = np.add.reduceat(c.mix(nodes.view(np.uint64)), np.flatnonzero(new))
            numbers = sums[np.cumsum(new) - 1].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(nodes)], ["key", "node_"])


def _grid(blocks: Column) -> Column:
    """Cells (left, right, probe) of a row: a pair of blocks is one run, the rows of the lesser as entries."""
    own = F.pmod(F.xxhash64("node_"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    return F.transform(
        every, lambda x: F.struct(F.least(own, x).alias("left"), F.greatest(own, x).alias("right"), (own > x).alias("probe"))
    )


def candidates(known: DataFrame, rings: range, crowd: int = CROWD) -> DataFrame:
    """(key, node_) groups of texts of which each has a close one in the group, of another component."""
    rows = entries(known, rings)
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    crowded = c.write_rows(crowded.select(F.col("key").alias("key_"), F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "near-crowds")
    one = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("probe")))
    cells = F.when(F.col("blocks").isNull(), one).otherwise(_grid(F.col("blocks")))
    dealt = rows.join(crowded, F.col("key") == F.col("key_"), "left").select("key", "node_", "fp_", "root_", F.explode(cells).alias("cell"))
    dealt = dealt.select("key", "cell.left", "cell.right", "node_", "fp_", "root_")
    ordered = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return ordered.mapInArrow(_close, "key bigint, node_ bigint").distinct()


def _blocks(members: DataFrame, texts: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Links between members (key, node_, fp_, root_, bytes_) of a key that are not in one component."""
    sized = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("bytes_").alias("size"), F.min("root_").alias("low"), F.max("root_").alias("high")
    )
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / block_bytes)).cast("int")
    mixed = sized.filter("low <> high").select(F.col("key").alias("key_"), blocks.alias("blocks"))
    rows = members.join(mixed, F.col("key") == F.col("key_")).drop("key_")
    dealt = rows.select("key", "node_", "fp_", "root_", F.explode(_grid(F.col("blocks"))).alias("cell")).select("key", "node_", "fp_", "root_", "cell.*")
    told = dealt.join(texts.withColumnRenamed("node_", "node2_"), F.col("node_") == F.col("node2_")).drop("node2_")
    ordered = told.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "probe", "node_")
    return ordered.mapInArrow(_runs, "a bigint, b bigint")


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    return nodes.join(found, F.col("node_") == F.col("node"), "left").select("node_", F.coalesce("root", "node_").alias("root_"))


def rooted(rows: DataFrame, nodes: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node_, root_) of all nodes, from written ``sketches`` (id_, text_) and their distinct nodes."""
    label = nodes.select("node_", F.col("node_").alias("root_"))
    edges = None
    for phase in PHASES:
        known = nodes.join(label.withColumnRenamed("node_", "node2_"), F.col("node_") == F.col("node2_")).drop("node2_")
        close = candidates(known, phase).withColumnRenamed("node_", "node2_")
        told = known.select("node_", "fp_", "root_", "bytes_")
        members = c.write_rows(close.join(told, F.col("node2_") == F.col("node_")).drop("node2_"), "near-blocks")
        asked = members.select(F.col("node_").alias("asked_")).distinct()
        wanted = nodes.join(asked, F.col("node_") == F.col("asked_"), "left_semi").select(
            F.col("node_").alias("asked_"), F.col("least_").alias("asked_id_")
        )
        # Written, so that its size is known: where it is small, the texts are not shuffled to be picked.
        wanted = c.write_rows(wanted, "near-asked")
        # One row per node: the least id, and one of the rows that repeat it.
        texts = rows.select("node_", "id_", "text_").join(
            wanted, (F.col("node_") == F.col("asked_")) & F.col("id_").eqNullSafe(F.col("asked_id_")), "left_semi"
        )
        texts = texts.groupBy("node_").agg(F.min("text_").alias("text_"))
        found = c.write_rows(_blocks(members, texts, block, block_bytes).distinct(), "near-links")
        edges = found if edges is None else edges.unionByName(found)
        label = c.write_rows(_roots(nodes.select("node_"), edges), "near-roots")
    return label


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All columns of the one row of each component that has the least id."""
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    own = [F.col(f"c{i}") for i in range(len(names))]
    flat = docs.toDF(*names.values())
    written = c.write_rows(sketches(flat, names[text_col]), "sketches")
    rows = written.withColumns({"id_": F.col(names[id_col]), "text_": F.col(names[text_col])})
    nodes = c.write_rows(
        rows.groupBy("node_").agg(
            F.min("id_").alias("least_"),
            F.first("fp_").alias("fp_"),
            F.first("rings_").alias("rings_"),
            F.max(F.octet_length("text_")).alias("bytes_"),
        ),
        "nodes",
    )
    label = rooted(rows, nodes, block, block_bytes).withColumnRenamed("node_", "node2_")
    winners = (
        nodes.join(label, F.col("node_") == F.col("node2_"))
        .groupBy("root_")
        .agg(F.min(F.struct(F.col("least_").isNull().alias("none_"), "least_", "node_")).alias("w"))
        .select(F.col("w.node_").alias("won_"), F.col("w.least_").alias("won_id_"))
    )
    same = (F.col("node_") == F.col("won_")) & F.col("id_").eqNullSafe(F.col("won_id_"))
    kept = rows.select("node_", "id_", "text_", *own).join(winners, same, "left_semi")
    # Equal sets of one id, in order of their texts and other columns.
    order = F.struct("text_", *own)
    least = kept.groupBy("node_", "id_").agg(F.min(order).alias("row_"))
    return least.select(*[F.col("row_").getField(v).alias(k) for k, v in names.items()])
