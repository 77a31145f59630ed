"""Near copies by shingle similarity: against all pairs in plain Python, recall, skew and edge rows."""

import random

import brute
import numpy as np
import pytest
from test_llm_edges import table

from spinecat.llm import near_copies as near

SF = "/root/testdata/sf0.001"


def varied(rnd, words, changes):
    out = list(words)
    for k in rnd.sample(range(len(out)), changes):
        out[k] = f"x{rnd.randrange(10**6)}"
    return out


def test_links_have_the_similarity_and_are_found(spark):
    """Pairs from 0.6 to 1: nothing below 0.8 is linked, of those from 0.8 on at least 0.9."""
    rnd = random.Random(5)
    docs = []
    for group in range(400):
        words = [f"w{rnd.randrange(50_000)}" for _ in range(rnd.choice([40, 120, 300]))]
        docs.append((2 * group, " ".join(words)))
        docs.append((2 * group + 1, " ".join(varied(rnd, words, rnd.randrange(1, max(2, len(words) // 25))))))
    groups, links = brute.similar_groups(docs)
    kept = {r["doc_id"] for r in near.keep_first(table(spark, docs)).collect()}
    gone = {i for i, _ in docs} - kept
    wanted = {k for k, _ in docs if groups[k] != k}
    assert len(wanted) > 150 and gone <= wanted
    assert len(gone) >= 0.97 * len(wanted)


@pytest.mark.parametrize("block", [near.BLOCK, 7])
def test_one_large_group_in_blocks(spark, block):
    """A chain of near copies, each like its neighbours but not like the far ones, is one component."""
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(90):
        docs.append((k, " ".join(words)))
        words = varied(rnd, words, 2)
    groups, _ = brute.similar_groups(docs)
    assert set(groups.values()) == {0}
    got = near.keep_first(table(spark, docs), block=block).collect()
    assert [r["doc_id"] for r in got] == [0]


def test_test_data_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    groups, _ = brute.similar_groups(docs)
    got = sorted(r["doc_id"] for r in near.keep_first(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == sorted(docs[k][0] for k in set(groups.values()))


def test_edge_rows(spark):
    first = near.keep_first(table(spark))
    assert first.columns == table(spark).columns
    # The fox stands at 1, 2, 2 and null; the empty texts at 3, 4 and 5.
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3, 6, 7, 8, 9]
    assert near.keep_first(table(spark, [])).count() == 0
    texts = [" ".join(f"{w}{k}" for k in range(20)) for w in ("ash", "birch", "cedar", "elm", "fir")]
    ids = [(None, 0), (None, 1), (None, 2), (None, 2), (5, 3), (5, 4), (5, 4), (7, 4), (None, 3)]
    got = near.keep_first(table(spark, [(i, texts[k]) for i, k in ids]))
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4])]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_chain_holds_every_pair_within_the_limit():
    rng = np.random.default_rng(1)
    x = np.zeros(4000, dtype=np.uint64)
    for k in range(len(x)):
        for b in rng.permutation(64)[: rng.integers(0, 30)]:
            x[k] |= np.uint64(1) << np.uint64(b)
    within = np.bitwise_count(x) <= near.BITS
    assert (near.chained(x) == within).all()  # the last budget is the whole distance


def test_texts_within_the_sure_bits_share_a_chain_key(spark):
    """Candidates come from segments of the fingerprints: any three bits of a ring may differ."""
    rng = np.random.default_rng(2)
    words = rng.integers(-(2**63), 2**63, 300).tolist()
    flips = [sum(1 << int(b) for b in rng.permutation(64)[: near.SURE]) for _ in words]
    others = [int(np.array([(w ^ f) & (2**64 - 1)], dtype=np.uint64).view(np.int64)[0]) for w, f in zip(words, flips, strict=True)]
    both = spark.createDataFrame(
        [(k % 24, w, o) for k, (w, o) in enumerate(zip(words, others, strict=True))], "ring int, word long, other long"
    )
    keys = [r["k"] for r in both.select(near.chain_keys(range(3, 24)).alias("k")).collect()]
    near_keys = both.select("ring", both["other"].alias("word")).select(near.chain_keys(range(3, 24)).alias("k"))
    for a, b in zip(keys, [r["k"] for r in near_keys.collect()], strict=True):
        assert len(set(a)) == len(near.WIDTHS) and set(a) & set(b)


def test_recall_at_the_least_similarity(spark):
    """Sets of 96 shingles within 120 others, of 4 within 5, of 8 within 10: 0.8 each, at least 0.9 are found."""
    rnd = random.Random(8)
    docs = []
    for words, more in ((100, 24), (8, 1), (12, 2)):
        for _ in range(250):
            own = [f"w{rnd.randrange(10**6)}" for _ in range(words + more)]
            docs += [(len(docs), " ".join(own[:words])), (len(docs) + 1, " ".join(own))]
    kept = {r["doc_id"] for r in near.keep_first(table(spark, docs)).collect()}
    assert all(k in kept for k, _ in docs[::2])
    for at in (0, 500, 1000):
        assert sum(k not in kept for k, _ in docs[at + 1 : at + 500 : 2]) >= 0.9 * 250


def test_crowded_keys_give_the_same_candidates(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(varied(rnd, words, 2))) for k in range(60)]
    rows = near.sketches(table(spark, docs), "text").selectExpr("node_", "fp_", "rings_", "node_ AS root_").localCheckpoint()
    found = [{r["node_"] for r in near.candidates(rows, range(2), crowd).collect()} for crowd in (near.CROWD, 7)]
    assert found[0] == found[1] and len(found[0]) > 50


def test_counters_of_a_byte_hold_long_texts():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 254, 255, 256, 4000, 511])
    flat = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    flat[sizes[:4].sum() : sizes[:5].sum()] |= np.uint64(1 << 40)
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for value, part in zip(near.majority(flat, sizes), np.split(bits, np.cumsum(sizes)[:-1]), strict=True):
        assert int(value) == sum(1 << k for k in range(64) if 2 * part[:, k].sum(dtype=int) > len(part))
