"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spinecat.llm import (
    chat,
    decontaminate,
    fm_index,
    host_rules,
    html_extract,
    language,
    mixing,
    pii,
    simhash,
    substrings,
    toxicity,
)
from spinecat.llm import common as c

LONG = "ab cd " * 40_000 + "end"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "123 ... !!!"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (8, "Écoute, ça va? 日本語 текст"),
    (9, "one"),
]
#: Columns that the operators use inside or return, as strangers in the input.
CLASH = "text_ string, id_ string, score string, spans string, n_words string, row string, copy string, key string, ids string"


def table(spark, rows=TEXTS, extra=True):
    base = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, None if k == 3 else "en", None if k == 4 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    if not extra:
        return spark.createDataFrame(full, base)
    return spark.createDataFrame([(*r, *["x"] * 9) for r in full], f"{base}, {CLASH}")


def plain(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_substrings(spark):
    got = substrings.cut(table(spark))
    known = [(i, t) for i, t in TEXTS if i is not None]
    expected = [*brute.repeats(known), (None, 16, 0, brute.sha(TEXTS[-3][1]))]
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=str)
    assert substrings.cut(table(spark, [])).count() == 0


def test_substrings_split_anchor(spark):
    """Anchors above the limit are split by window and find the same repeats."""
    common = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(k, f"x{k} y{k} {common} z{k} w{k % 3} v") for k in range(40)]
    rows += [(100 + k, f"{common} q{k} x{k} y{k} a b c d e f g h i j k") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    candidates, removed = substrings.repeats(docs, hot=4, shard=7)
    got = {r["id_"]: set(r["firsts"]) for r in removed.collect()}
    least = {}
    for i, t in rows:
        ws = t.split()
        for k in range(len(ws) - 12):
            least.setdefault(tuple(ws[k : k + 13]), i)
    for i, t in rows:
        ws = t.split()
        want = {k for k in range(len(ws) - 12) if least[tuple(ws[k : k + 13])] < i}
        assert got.get(i, set()) == want


def test_fm_index_matches_plain_search():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 5, 400)
    symbols[-1] = 0
    index = fm_index.FMIndex(symbols, 6)
    ends = np.arange(len(symbols))
    length, low, high = index.matching(symbols, ends, 6)
    text = symbols.tolist()
    for e in range(len(text)):
        best = 0
        for n in range(1, 7):
            part = text[e - n + 1 : e + 1]
            if e - n + 1 < 0 or 0 in part or sum(text[k : k + n] == part for k in range(len(text))) < 2:
                break
            best = n
        assert length[e] == best
        if best:
            part = text[e - best + 1 : e + 1]
            places = {k for k in range(len(text)) if text[k : k + best] == part}
            assert set(index.suffixes[low[e] : high[e]].tolist()) == places


def test_decontaminate(spark):
    items = [(1, "quick brown fox jumps over the lazy dog and runs far"), (2, "One"), (3, None), (4, "..."), (5, "текст"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted([x[1:] for x in brute.contamination(TEXTS, items)], key=str)
    for part_words in (500_000, 3):
        found = decontaminate.find(table(spark), bench, part_words=part_words)
        digest = decontaminate.items_digest().alias("d")
        got = found.select("n_words", decontaminate.n_hit().alias("h"), "items", digest)
        assert sorted([(r[0], r[1], len(r[2]), r[3], r[1] > 0) for r in got.collect()], key=str) == expected
        cleaned = decontaminate.clean(found)
        assert cleaned.columns == table(spark).columns
        # Shorter matches than a span of ten words stay; texts that are mostly benchmark go.
        assert {r["doc_id"] for r in cleaned.collect()} == {3, 4, 5, 6, 7, 8}
    assert decontaminate.find(table(spark, []), bench).count() == 0
    assert decontaminate.find(table(spark), bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_short_items_are_cut(spark):
    """Whole items shorter than a window, alone, next to others and next to a window."""
    rest = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"q{k}" for k in range(10))
    items = [(1, "Why is it?"), (2, long), (3, "red fox"), (4, "a b c d e f g h i"), (5, "it so")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {
        f"x, why is -- it? {rest}": f"x, ? {rest}",
        f"{rest} the red fox is it": f"{rest} the red fox is it",
        f"{rest} a b c d e f g h i.": f"{rest} .",
        f"{rest} a b c d e f g h.": f"{rest} a b c d e f g h.",
        f"{rest} why is it so; red fox {long}, end": f"{rest} , end",
        f"{rest} y, {long} why is it z why is it": f"{rest} y,  z ",
        f"{rest} red fox": f"{rest} red fox",
    }
    for part_words in (500_000, 3):
        found = decontaminate.find(table(spark, list(enumerate(texts))), bench, part_words=part_words)
        got = {r["doc_id"]: r["text"] for r in decontaminate.clean(found).collect()}
        assert got == dict(enumerate(texts.values()))


def test_automaton_random_windows():
    rng = np.random.default_rng(2)
    items = [(str(k), [bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(1, 12))]) for k in range(30)]
    automaton = decontaminate.Automaton(items, 4)
    text = [bytes([97 + x]) for x in rng.integers(0, 3, 300)]
    got = set()
    for end, size, who in automaton.walk(text):
        got |= {(end - size, end, x) for x in who}
    want = set()
    for item, words in items:
        n = min(4, len(words))
        for k in range(len(words) - n + 1):
            want |= {(a, a + n, item) for a in range(len(text) - n + 1) if text[a : a + n] == words[k : k + n]}
    assert got == want


def test_simhash(spark):
    got = simhash.assign(table(spark), size=4)
    known = [(k if i is None else i, t) for k, (i, t) in enumerate(TEXTS)]
    prints = {i: f"{brute.simhash(t):016x}" for i, t in known if i != 8 or True}
    for r in got.collect():
        if r["doc_id"] is not None:
            assert r["fingerprint"] == prints[r["doc_id"]]
    parts = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert parts[1] == parts[2] == parts[None] == 1
    assert parts[3] == parts[4] == parts[5] == 3
    assert simhash.assign(table(spark, [])).count() == 0
    first = simhash.keep_first(table(spark), size=4)
    assert first.columns == table(spark).columns
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3, 6, 7, 8, 9]


def test_simhash_keeps_one_of_each_component(spark):
    """Null ids, and one id with two texts, name several components."""
    texts = [" ".join(f"{w}{k}" for k in range(20)) for w in ("ash", "birch", "cedar", "elm", "fir")]
    ids = [(None, 0), (None, 1), (None, 2), (None, 2), (5, 3), (5, 4), (5, 4), (7, 4), (None, 3)]
    prints = {brute.simhash(t) for t in texts}
    assert all(a == b or (a ^ b).bit_count() > 4 for a in prints for b in prints) and len(prints) == 5
    got = simhash.keep_first(table(spark, [(i, texts[k]) for i, k in ids]), size=4)
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4])]
    assert plain(got, "doc_id", "text") == sorted(want, key=str)


def test_simhash_links_all_and_splits_hot_keys(spark):
    rng = np.random.default_rng(4)
    fps = set(rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist())
    for base in list(fps)[:6]:  # dense neighbourhoods, and chains of links
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    links = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4]
    want = brute.components(fps, links)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    distinct = spark.createDataFrame(signed, "fp long")
    for hot in (simhash.HOT, 8):
        edges = [(r["a"], r["b"]) for r in simhash.links(distinct, hot).collect()]
        unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in edges]
        assert brute.components(fps, unsigned) == want
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, hot)).collect()}
        groups = {}
        for x in fps:
            s = int(np.uint64(x).astype(np.int64))
            groups.setdefault(roots.get(s, s), set()).add(x)
        expected = {}
        for x in fps:
            expected.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_language(spark):
    rows = [(k, t) for k, t in enumerate(["the house and the tree", "la casa y el rio", "das haus und der baum"] * 30)]
    langs = ["en", "es", "de"]
    docs = spark.createDataFrame([(i, t, langs[i % 3]) for i, t in rows], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.label(table(spark), model, spans=True).select("row.doc_id", "lang_pred", "score", "spans").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert {i: by[i]["lang_pred"] for i in (3, 4, 5, 7)} == dict.fromkeys((3, 4, 5, 7), "und")
    assert by[1]["lang_pred"] == "en" and by[4]["score"] == 0 and by[4]["spans"] == []
    assert len(got) == len(TEXTS)
    mixed = spark.createDataFrame([(1, "the house and the tree " * 6 + "la casa y el rio " * 14)], "doc_id long, text string")
    row = language.label(mixed, model, spans=True).collect()[0]
    assert [s["lang"] for s in row["spans"]] == ["en", "es"] and row["lang_pred"] == "es"
    assert language.label(table(spark, []), model).count() == 0
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.label(table(spark), empty).collect()} == {"und"}


def test_language_needs_letters(spark):
    docs = spark.createDataFrame([(i, "the house", "en") for i in range(8)], "doc_id long, text string, lang string")
    texts = ["½ ² ①", "Ⅷ", "12 _ 3", "́̈", "a½", "हिन्दी", "ខ្មែរ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.label(rows, language.train(docs), spans=True).select("row.doc_id", "lang_pred", "spans").collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und"] * 4 + ["en"] * 3
    assert [(s["start"], s["end"]) for s in got[5]["spans"]] == [(0, len(texts[5]))]


def test_language_stage_uses_the_prediction(spark):
    """Mixtures without a main language go; a missing label is filled in."""
    langs = {"en": "the house and the tree", "es": "la casa y el rio", "de": "das haus und der baum", "fr": "le chien est dans une rue", "xx": "zqz qzq zzq qqz"}
    rows = [(20 * i + k, t, lang) for i, (lang, t) in enumerate(langs.items()) for k in range(20)]
    mixture = " ".join(f"{t} {t}" for t in langs.values())
    rows += [(1001, mixture, "en"), (1002, langs["es"] * 3, None), (1003, "½ 12", "en"), (1004, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert set(kept) == {r[0] for r in rows if r[0] < 1000} | {1002}
    assert kept[1002] == "es"


def test_samples_are_bounded(spark, monkeypatch):
    """Pages without ids, and one label row many times, make no sample longer."""
    seen = []
    monkeypatch.setattr(html_extract, "fit", lambda pages: seen.append(len(pages)))
    pages = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) AS page_id", "concat('<p>', if(id % 3 = 1, 7, id), '</p>') AS html")
    html_extract.train(pages)
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(len(texts)))
    labels = spark.range(9000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "int(id % 2) AS toxic")
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "concat('text ', id) AS text")
    toxicity.train(docs, labels, sample=500)
    assert 0 < seen[0] <= 300 and 0 < seen[1] <= 650


def test_language_stage_without_labels(spark):
    docs = table(spark)
    kept = corpus_pipeline.language_id(spark, docs, "")
    bare = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert bare.columns == docs.columns and bare.count() > 0
    assert plain(bare, "doc_id", "text") == plain(kept, "doc_id", "text")


def test_language_holds_few_words_at_once(spark, monkeypatch):
    """The n-grams of a slice's words are made in parts, and counts and scores are those of all at once."""
    words = [f"w{a}{b}{c_}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "éabcdefghijklmnopqrstuvwxyz" for c_ in "abcdefghijklmnopqrstuvwxyzàñüö"]
    assert len(set(words)) > 2 * language.AT_ONCE
    model = language.train(spark.createDataFrame([(1, " ".join(words), "aa")], "doc_id long, text string, lang string"))
    whole = language.features(words)
    grams = np.bincount(whole[1], minlength=language.BUCKETS) + 0.5
    assert np.allclose(model["logs"][:, 0], np.log(grams / grams.sum()) / len(language.LENGTHS), rtol=1e-6)
    sizes, features = [], language.features
    monkeypatch.setattr(language, "features", lambda new: sizes.append(len(new)) or features(new))
    two = {"langs": ["aa", "bb"], "logs": np.random.default_rng(4).normal(size=(language.BUCKETS, 2)).astype(np.float32), "scripts": np.ones((2, len(language.SCRIPT_NAMES)), dtype=bool)}
    scorer = language.Scorer(two)
    for word in words:
        scorer.words[word]
    scorer.update()
    assert max(sizes) <= language.AT_ONCE and sum(sizes) == len(words)
    assert (scorer.scores == scorer._score(words)).all()


def test_pipeline_batches_are_bounded(spark):
    """10,000 rows of 2 KB are not one Arrow batch."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.mixing_sources(spark, table(spark, extra=False), "")

    def sizes(batches):
        for batch in batches:
            yield c.pa.RecordBatch.from_arrays([c.pa.array([batch.nbytes])], ["size"])

    rows = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = [r["size"] for r in rows.mapInArrow(sizes, "size long").collect()]
    assert sum(got) > 20_000_000 and max(got) < 9_000_000


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 7, 1])
    scores = rng.normal(size=(13, 3))
    starts = np.cumsum(sizes) - sizes
    labels = language.viterbi(scores, starts, sizes, 1.0)
    from itertools import product

    for a, n in zip(starts, sizes, strict=True):
        if n:
            value = lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - sum(x != y for x, y in zip(p[1:], p[:-1], strict=True))  # noqa: B023, E731
            assert np.isclose(value(labels[a : a + n]), max(map(value, product(range(3), repeat=int(n)))))


def test_host_rules(spark):
    got = host_rules.judge(table(spark))
    assert plain(got, "doc_id", *host_rules.COUNTS, "base_failed") == sorted(brute.rule_counts(TEXTS), key=str)
    assert not any(r["kept"] for r in got.collect() if r["base_failed"])
    assert host_rules.judge(table(spark, [])).count() == 0
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(60)] + [(k, "bad") for k in range(60, 100)]
    docs = spark.createDataFrame([(i, t, "good" if i < 59 else "poor") for i, t in rows], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_rules.judge(docs).collect() if r["kept"]}
    assert kept == set(range(59))  # 59 is clean, but from a host that fails


ODD = [
    "a@b.c x@y..z@w.de q_a@b.c_x@d.e +1 (22) 333-4444 55",
    "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111",
    "0000000000000 12 34 56 78 90 12 3 " + "1 " * 3000 + "+12345678901 +1-2-3",
    "1" * 20_000 + " " + "a" * 50_000 + "@" + " " + "é" * 30 + "@x.fr",
    "日本 a.b@c.org 8.8.8.8",
    None,
    "",
]


def test_pii_base(spark):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(ODD)], "doc_id long, text string, spans string, kind string")
    found = pii.spans(docs)
    for r in found.collect():
        got = [(x["kind"], x["start"], x["end"]) for x in r["pii_base"]]
        assert got == brute.private(ODD[r["doc_id"]])
        assert set(got) <= {(x["kind"], x["start"], x["end"]) for x in r["pii_all"]}
    assert pii.redact(docs).columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[5] == "日本 [EMAIL] [IP]" and out[6] is None and out[7] == ""
    assert pii.spans(docs.limit(0)).count() == 0
    assert pii.redact(table(spark)).count() == len(TEXTS)


def test_pii_long_domain(spark):
    """An address ends with its domain, however many labels that has."""
    for labels in (3_000, 100_000):
        address = "me@" + "ab." * labels + "org"
        docs = spark.createDataFrame([(1, f"to {address}, or {address}. x@y")], "doc_id long, text string")
        found = docs.select(pii.matches(F.col("text"), pii.EMAIL, "email").alias("found")).first()["found"]
        size = len(address)
        assert [(x["start"], x["end"]) for x in found] == [(3, 3 + size), (8 + size, 8 + 2 * size)]
        if labels == 3_000:
            assert pii.redact(docs).first()["text"] == "to [EMAIL], or [EMAIL]. x@y"


def test_pii_candidates(spark):
    good = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    texts = [good, "Oneaen ththerblehandtionerrestouen stands alone", "call (212) 555-0143 now", "on 2021-03-04 and 12.05.2020"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][x["start"] : x["end"]] for x in r["pii_all"]] for r in pii.spans(docs).collect()}
    assert got[0] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert got[1] == [] and got[3] == []
    assert got[2] == ["(212) 555-0143"]


def test_mixing(spark):
    docs = table(spark, [(k, f"t{k}") for k in range(300)], extra=False).drop("source")
    docs = docs.selectExpr("*", "case when doc_id < 200 then 'big' when doc_id < 299 then 'small' end as source", "'x' as copy")
    got = mixing.mix(docs).collect()
    assert sorted(got[0].asDict()) == ["copy", "doc_id", "lang", "n_chars", "shuffle_key", "source", "text"]
    by = {s: sum(r["source"] == s for r in got) for s in ("big", "small", None)}
    assert all(70 <= n <= 135 for n in by.values())  # a third each of 300, as Poisson numbers
    only = mixing.mix(docs, weights={"small": 1.0}, size=0.5).collect()
    assert {r["source"] for r in only} == {"small"} and 110 <= len(only) <= 190
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={"none": 1.0}).count() == 0
    odd = table(spark)
    whole = mixing.mix(odd, size=200.0)
    assert whole.columns == [*(x for x in odd.columns if x not in ("copy", "shuffle_key")), "copy", "shuffle_key"]
    assert {r[0] for r in whole.select("doc_id").collect()} == {r[0] for r in odd.select("doc_id").collect()}


def test_mixing_without_ids(spark):
    """A third of the rows have no id and a third share one: weights hold, and keys are spread."""
    docs = spark.range(3000).selectExpr(
        "case id % 3 when 0 then id when 1 then 77 end AS doc_id", "'same' AS text", "if(id % 2 = 0, 'a', 'b') AS source"
    )
    got = mixing.mix(docs, size=1.0).collect()
    assert abs(len(got) - 3000) < 5 * 3000**0.5
    for source in ("a", "b"):
        assert abs(sum(r["source"] == source for r in got) - 1500) < 5 * 1500**0.5
    for own in (None, 77):
        rows = [r for r in got if r["doc_id"] == own]
        assert abs(len(rows) - 1000) < 5 * 1000**0.5
        assert len({r["shuffle_key"] for r in rows}) == len(rows)
    again = mixing.mix(docs, size=1.0).select("shuffle_key", "copy").collect()
    assert {(r["shuffle_key"], r["copy"]) for r in got} == {tuple(r) for r in again}


def test_mixing_rare_source(spark):
    """One document makes up half of the corpus: its copy numbers are made piece by piece."""
    docs = spark.range(8001).selectExpr("id AS doc_id", "'t' AS text", "if(id = 0, 'rare', 'common') AS source")
    got = mixing.mix(docs).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    assert abs(counts["rare"] - 4000) < 5 * 4000**0.5 and abs(counts["common"] - 4000) < 5 * 4000**0.5
    assert mixing.mix(docs).filter("source = 'rare'").agg(F.max("copy")).first()[0] == counts["rare"] - 1


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "␛1<␛0|turn|>␛", "<|tu<|turn|>rn|>", "", None, "日本\n語 <|end|><|text|>", "x " * 60_000 + "y" * 120_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)]
    rows += [(2, None, None, "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 0, "user", "<s>"), (3, 0, "<|end|>", "c")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.conversations(chat.format_turns(table)).collect()}
    known = brute.chats([(10**9 if r[0] is None else r[0], *r[1:]) for r in rows])
    assert got == {None if k == 10**9 else k: v for k, v in known.items()}
    assert chat.conversations(chat.format_turns(table.limit(0))).count() == 0
    for text in filter(None, hard):
        assert chat.unescape(chat.escape(text)) == text
        assert not chat.CONTROL.search(chat.escape(text))


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two,\n three.<p>Four &lt;five&gt;.</article><footer>(c)</footer>"),
    None,
    "",
    "no markup, just words",
    "<script>var a = '<p>x</p>'</script><!-- c --><style>p{}</style>",
    "<div " * 3000,
    "<div>" * 3000 + "deep",
    "<article><p>" + "word, " * 30_000 + "</p></article>",
    "&am<p>&#x41;&nbsp;&eacute;",
]


def test_html(spark):
    docs = spark.createDataFrame([(k, "u", t, "x", "y") for k, t in enumerate(PAGES)], "page_id long, url string, html string, text string, row string")
    done = {r["row"]["page_id"]: r["text"] for r in html_extract.main_text(docs).collect()}
    assert done[0] == "T & U\nOne two, three.\nFour <five>."
    assert done[1] == done[2] == done[4] == ""
    assert done[7] == ("word, " * 30_000).strip()
    assert len(done) == len(PAGES)
    assert html_extract.main_text(docs.limit(0)).count() == 0


UNSEEN_PAGES = [
    "<html><head><title>x</title><body>{}</body></html>",
    "<html><head><meta charset=u><title>x</title><style>p {{}}</style>{}</html>",
    "<head><title>x</title><noscript><link></noscript><script>a < b</script><template><p>no</p></template>{}",
    "<head><noscript><body>{}",
    "<body><svg/><math/>{}<iframe/>",
    "<body><div><svg><title/><style/><path/></svg></div>{}",
    "<body><div><object><p>no</p></div>{}",
    "<body><div><svg><g></div>{}",
    "<body><div><noscript><div>no<svg></div>no</noscript></div>{}",
    "<body><select><option>no</select><div><object><div>no</div>no</object></div>{}",
]


def test_html_unseen_elements_end():
    article = "<article><h1>A title</h1><p>One two, three, and more of it.</p><svg/><p>Four <svg><title/></svg>five, six.</p></article>"
    for page in UNSEEN_PAGES:
        source = page.format(article)
        texts = ["A title", "One two, three, and more of it.", "Four five, six."]
        assert [t for _, t, _ in html_extract.parse(source).blocks] == texts, page
    assert [t for _, t, _ in html_extract.parse("<head><title>x</title>Bare <b>text</b>").blocks] == ["Bare text"]
    assert html_extract.parse("<head><title>x</title> <meta> </head>").blocks == []


def test_html_layouts():
    """Unseen made-up layouts: articles among menus, notices, adverts, forms and comments."""
    import random

    rng = random.Random(77)
    texts = [["A title of the page, short", *[f"Sentence {k} of it, with {j} words and an end. " * 3 for j in range(4)]] for k in range(20)]
    model = html_extract.fit([])
    good = 0
    for k in range(60):
        page = html_extract.parse(source := html_extract._layout(rng, texts[k % 20], "home news about more share".split()))
        gold = html_extract._golden(page)
        good += html_extract.extract([source], model)[0] == "\n".join(t for n, t, _ in page.blocks if gold[n])
    assert good >= 45


def test_decode_never_contradicts():
    rng = np.random.default_rng(5)
    parent = [-1, *(int(rng.integers(0, k)) for k in range(1, 60))]
    kept = html_extract.decode(parent, rng.random(60))
    assert all(kept[parent[k]] for k in range(1, 60) if kept[k])


def test_toxicity(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 10)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.train(table(spark), labels)
    got = toxicity.score(table(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train(table(spark), labels.limit(0))
    assert {r["score"] for r in toxicity.score(table(spark), none).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0


def test_toxicity_gradients():
    """Analytic gradients against differences."""
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["alpha", "beta", "gamma", "delta"]
    ids = np.array([[0, 1, 2, 4, 4], [3, 3, 1, 0, 4]])
    y = np.array([1.0, 0.0])

    def loss():
        x, _ = net.inputs(words)
        z = net.forward(net.project(x.astype(np.float64)), ids).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    x, made = net.inputs(words)
    _, grads = net.gradients(x, made, ids, y)
    for name, g in grads.items():
        flat, own = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in np.argsort(-np.abs(own))[:2]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert np.isclose((up - down) / 2e-2, own[k], rtol=0.05, atol=2e-4), name


def test_toxicity_windows_cover_all_words():
    sizes = np.array([0, 1, 24, 25, 37, 200])
    rows, firsts = toxicity.windows(sizes)
    for k, n in enumerate(sizes):
        covered = {w for f in firsts[rows == k] for w in range(f, f + toxicity.WINDOW)}
        assert set(range(n)) <= covered


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    bench = spark.createDataFrame([(1, TEXTS[0][1])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark)
    out = stage(spark, docs, str(tmp_path))
    out.collect()
    assert stage(spark, table(spark, []), str(tmp_path)).count() == 0
    if name != "mixing":
        assert out.columns == docs.columns


def test_hashes_do_not_depend_on_the_slice():
    text = "alpha beta gamma".encode()
    data = np.frombuffer(b"xx " + text, dtype=np.uint8)
    a = c.word_hashes(*_spans(np.frombuffer(text, dtype=np.uint8)))
    b = c.word_hashes(*_spans(data))
    assert a.tolist() == b[1:].tolist()


def _spans(data):
    starts, ends, _ = c.word_spans(data, np.array([0, len(data)]), c.SPACES)
    return data, starts, ends
