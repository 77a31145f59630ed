"""Packing, spelling variants and source divergence: plain versions, edge cases, hot keys."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinecat.llm import common, divergence, packing, perfect_hash, queries, spelling
from spinecat.llm.distinct import distinct

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def slice_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


ODD_TEXTS = [
    "", " ", "\n\n x", "a  b", "word.\nNext  line ", "don't  'll x　 y", "é é  è", "<|endoftext|> a<|endoftext|>b <|x",
    "日本語 の テキスト", "a  b", "\t tab\r\n end", "x" * 3000, "1 22 333 ½ ² ①", "🙂 ok 🙂🙂", "<| end", " ".join(["aé"] * 50),
]


def test_encoder_equals_whole_text(whole):
    own = packing.encoder(packing.tokenizer_file())
    chance = random.Random(5)
    letters = "ab é\n.' <| 　ß×1日🙂\t"
    texts = ODD_TEXTS + ["".join(chance.choices(letters, k=chance.randrange(60))) for _ in range(400)]
    ids, counts = packing.encode(*slice_of(texts), own)
    stops = np.append(0, np.cumsum(counts))
    for i, text in enumerate(texts):
        assert ids[stops[i] : stops[i + 1]].tolist() == whole(text), text


def check_pieces(pieces, docs, whole, size):
    """Every id in one piece, sequences without gaps and without padding."""
    at = defaultdict(list)
    for r in pieces:
        at[r["sequence_id"]].append(r)
    lengths = []
    for number in range(len(at)):
        reach = 0
        for r in sorted(at[number], key=lambda r: r["offset"]):
            assert r["offset"] == reach and r["length"] > 0
            reach += r["length"]
        lengths.append(reach)
    assert all(x == size for x in lengths[: sum(lengths) // size])
    assert all(x & (x - 1) == 0 for x in lengths)
    parts = Counter((r["doc_id"], r["doc_tokens"], r["start"], bytes(r["ids"])) for r in pieces)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*whole(text), 0], dtype="<u4")
        own = [p for p in parts if p[0] == doc_id and p[1] == len(ids) and ids[p[2] : p[2] + len(p[3]) // 4].tobytes() == p[3]]
        assert sum(len(p[3]) // 4 * parts[p] for p in own) >= len(ids)
        want[(doc_id, len(ids))] += len(ids)
    for (doc_id, n), tokens in want.items():
        assert sum(r["length"] for r in pieces if (r["doc_id"], r["doc_tokens"]) == (doc_id, n)) == tokens


def test_op11_plain(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(docs).collect()
    check_pieces(pieces, texts, whole, 1024)
    got = {(r["doc_id"], r["start"]): r for r in queries.op11_packing(spark, SF).collect()}
    assert {k: r["ids_crc32"] for k, r in got.items()} == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in pieces}
    lines = packing.sequences(packing.pack(docs)).collect()
    assert sum(len(r["ids"]) for r in lines) == 4 * sum(r["n"] for r in lines) == 4 * sum(len(whole(t)) + 1 for _, t in texts)


def test_op11_edges(spark, whole):
    rows = [(i if i % 3 else None, t, "en", "s") for i, t in enumerate(ODD_TEXTS)] + [(7, None, "en", "s")] * 3 + [(9, "same text", None, None)] * 40
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("key", "n", "ids", "tag", "place", "id_", "stretch"):
        docs = docs.withColumn(name, F.lit("clash"))
    check_pieces(packing.pack(docs, size=64).collect(), [r[:2] for r in rows], whole, 64)
    assert packing.pack(docs.limit(0)).collect() == []
    assert packing.pack(docs.limit(0)).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_op11_hot_key_is_split(spark):
    """A third of all rows are one text under one id: their ranges differ by the tag."""
    docs = spark.range(3000).selectExpr("id % 3 * id AS doc_id", "if(id % 3 = 0, 'same words here', concat('word ', id)) AS text")
    spread_out = packing.line(packing.tokens(docs))
    assert spread_out.select("place").distinct().count() == 3000
    keys = packing.tokens(docs).repartitionByRange(4, "key", "id_", "tag").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in keys) < 1200


def test_hilbert_steps_are_neighbours():
    for bits, axes in ((3, 2), (2, 4), (3, 3)):
        cells = np.array(list(product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).tolist()) == {1}


def test_curve_brings_like_documents_together(spark):
    rows = [(k * 100 + i, f"{w} " * 30 + f"{w}{i}") for k, w in enumerate(("river", "engine", "music", "stone")) for i in range(40)]
    random.Random(1).shuffle(rows)
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [r["doc_id"] // 100 for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 0.9 * len(order)


def test_tail():
    assert packing.tail_starts(1024 * 3, 1024) == []
    assert packing.tail_starts(1024 + 700, 1024) == [1024, 1536, 1664, 1696, 1712, 1720]


def plain_words(docs):
    import re

    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spelling.SLIP == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_near(words):
    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    words = sorted(words)
    return {(a, b) for a in words for b in words if a != b and near(a, b)}


def plain_forms(words):
    near = defaultdict(list)
    for a, b in plain_near(words):
        near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_op12_plain_with_every_crowd(spark):
    chance = random.Random(3)
    words = {}
    for stem in ("kitten", "mittens", "éclairs", "aaaaaaaa", "straßenbahn", "zz" * 20):
        words[stem] = 4000
        for _ in range(60):
            w, i = list(chance.choice(sorted(words))), 0
            i = chance.randrange(len(w))
            w[i : i + chance.randrange(2)] = chance.choice(["", "a", "é", "z", "t"])
            if len(w) >= 6:
                words.setdefault("".join(w), chance.choice([5, 30, 160, 800]))
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_forms(words)
    assert any(r[1] and r[1] != r[2] for r in want)
    for crowd in (1, 2, 64, 10**9):
        got = [tuple(r) for r in spelling.group(counted, crowd=crowd).collect()]
        assert len(got) == len(want) and set(got) == want


def test_op12_counts(spark):
    rows = [(i, "Hello-World wörter×x ÀÉÿabc bĀstraßen " * (1 + i % 3) + "q" * 90) for i in range(60)]
    rows += [(None, "Hello-World"), (3, None), (3, ""), (4, "Hello-World")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert dict(map(tuple, spelling.words(docs).collect())) == plain_words(rows)
    assert spelling.variants(docs.limit(0)).collect() == []
    assert {tuple(r) for r in spelling.variants(docs).collect()} == plain_forms(plain_words(rows))


def test_op12_hot_prefix_makes_no_square(spark):
    """Thousands of words under one chunk: the candidates stay in proportion to the words."""
    counted = spark.range(4000).selectExpr("concat('prefix', conv(id * 7919, 10, 36)) AS word", "5L AS n")
    words = [r["word"] for r in counted.collect()]
    rest = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest[w[:i] + "*" + w[i + 1 :]].add(w)
            rest[w[:i] + w[i + 1 :]].add(w)
    pairs = {tuple(sorted((a, b))) for w in words for i in range(len(w)) for a in [w] for b in rest[w[:i] + "*" + w[i + 1 :]] if a != b}
    pairs |= {tuple(sorted((a, w))) for w in words for a in rest.get(w, ()) if a != w}
    got = spelling.near_words(counted)
    assert {tuple(sorted((r["a"], r["b"]))) for r in got.collect()} == pairs
    assert got.count() == len(pairs)


def test_crc_table():
    texts = ["a", "hello", "é" * 40, "x" * 64, "x" * 65]
    data, offsets = slice_of(texts)
    state = np.full(len(texts), zlib.crc32(b"12:"), dtype=np.uint32)
    got = spelling.crc_from(state, data, offsets[:-1], offsets[1:])
    assert got.tolist() == [zlib.crc32(b"12:" + t.encode()) for t in texts]


def test_perfect_hash():
    words = sorted({f"w{i * i}" for i in range(5000)})
    data, offsets = slice_of(words + ["unknown", "w1x"])
    hashes = common.word_hashes(data, offsets[:-1], offsets[1:])
    n = len(words)
    shard = np.arange(len(hashes)) % 3
    parts = []
    for k in range(3):
        own = np.flatnonzero(shard[:n] == k)
        sizes, bits, slots = perfect_hash.build(hashes[own])
        assert sorted(slots.tolist()) == list(range(len(own)))
        parts.append((sizes, bits, [words[own[i]].encode() for i in np.argsort(slots)]))
    shards = perfect_hash.Shards(parts)
    got = shards.slots(hashes, shard, data, offsets[:-1], offsets[1:])
    assert (got[n:] == -1).all() and sorted(got[:n].tolist()) == list(range(n))
    assert (shards.slots(hashes, np.full(len(hashes), -1), data, offsets[:-1], offsets[1:]) == -1).all()


def test_perfect_hash_equal_hashes():
    """Keys of one 64-bit hash are told apart by their bytes."""
    data, offsets = slice_of(["aa", "bb", "cc", "dd"])
    hashes = np.array([5, 5, 9, 5], dtype=np.uint64)
    sizes, bits, slots = perfect_hash.build(hashes[:3])
    keys = [[b"aa", b"bb", b"cc"][i] for i in np.argsort(slots)]
    shards = perfect_hash.Shards([(sizes, bits, keys)])
    got = shards.slots(hashes, np.zeros(4, dtype=np.int64), data, offsets[:-1], offsets[1:])
    assert sorted(got[:3].tolist()) == [0, 1, 2] and got[3] == -1


def test_distinct_equal_hashes():
    data, offsets = slice_of(["aa", "bb", "aa", "cc"])
    first, inverse = distinct(data, offsets[:-1], offsets[1:], np.zeros(4, dtype=np.int64), np.ones(4, dtype=np.uint64))
    assert len(first) == 3 and inverse[0] == inverse[2] and len(set(inverse.tolist())) == 3


def plain_audit(rows, min_docs, top):
    import re

    docs = [(re.findall("[^\x00-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), la or "", s or "") for t, la, s in rows]
    seen = Counter((la, w) for ws, la, _ in docs for w in set(ws))
    kept = defaultdict(list)
    for (la, w), n in sorted(seen.items()):
        if n >= min_docs:
            kept[la].append(w)
    counts = defaultdict(Counter)
    for ws, la, s in docs:
        own = [w for w in ws if w in set(kept[la])]
        counts[la, s].update(own)
        counts[la, None].update(own)

    def p(la, s):
        total = sum(counts[la, s].values()) + 5 * len(kept[la])
        return {w: 1 + 10**9 * (counts[la, s][w] + 5) // total for w in kept[la]}

    out = set()
    groups = sorted({(la, s) for _, la, s in docs})
    for la, s in groups:
        own, q = p(la, s), p(la, None)
        pairs = [(-sum(abs(own[w] - p(la, t)[w]) for w in own), t.encode()) for x, t in groups if x == la and t != s]
        terms = [(q[w] - own[w], w.encode()) for w in own if counts[la, s][w] > 0 and own[w] > q[w]]
        out |= {(la, s, "pair", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(pairs), 1)}
        out |= {(la, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(sorted(terms)[:top], 1)}
    return out


def audit_rows():
    chance = random.Random(11)
    words = ["Alpha", "beta", "gamma_delta", "été", "Straße", "x1y", "日本", "Omega", "zz", "ÀB"]
    rows = [(" ".join(chance.choices(words, k=chance.randrange(40))), chance.choice(["en", "fr", None]), chance.choice("abcdef")) for _ in range(150)]
    return rows + [(None, "en", None), ("", "xx", "a"), ("solo", "xx", "b"), (None, "yy", "a")] + [("beta beta zz", "en", "a")] * 30


@pytest.mark.parametrize("shard_keys, block, round_bytes, dense", [(4096, 256, 32_000_000, 4_000_000), (2, 2, 40, 3)])
def test_op13_plain(spark, monkeypatch, shard_keys, block, round_bytes, dense):
    """Also with many shards, blocks, passes and overflowing counters."""
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1))
    monkeypatch.setattr(divergence.recount, "__defaults__", (round_bytes, dense))
    got = [tuple(r) for r in divergence.audit(docs, min_docs=5, top=4, shard_keys=shard_keys, block=block).collect()]
    want = plain_audit(rows, 5, 4)
    assert len(got) == len(want) and set(got) == want


def test_op13_edges(spark):
    docs = spark.createDataFrame([("rare words", "en", "a"), ("others", "en", "b"), (None, None, None)], "text string, lang string, source string")
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(docs.limit(0)).collect() == []


def test_share_of_large_counts(spark):
    cases = [(5, 10), (10**15, 3 * 10**15 + 7), (2 * 10**15, 2 * 10**15), (1, 9 * 10**15)]
    df = spark.createDataFrame(cases, "n long, total long")
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"))).collect()] == [1 + 10**9 * a // b for a, b in cases]
