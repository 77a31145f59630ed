"""Registered queries of the text operators: against DuckDB, and against plain Python where SQL falls short."""

import hashlib
import math
import re
from collections import Counter

import brute
import pytest
from compare import compare, connect

import corpus_pipeline
from spinecat.llm import oracle, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(oracle.STATEMENTS) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(oracle.STATEMENTS))
def test_same_rows(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_op1_marked_article(spark, con):
    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    got = {r["page_id"]: r for r in queries.op1_main_text(spark, SF).collect()}
    import html

    for page_id, source in pages:
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[page_id]["text"] == "\n".join(p for p in parts if p)
        assert got[page_id]["n_chars"] == len(got[page_id]["text"])


def test_op4_plain(spark, docs):
    assert rows(queries.op4_substrings(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(brute.repeats(docs))


def test_op5_plain(spark, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = queries.op5_decontaminate(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got) == sorted(brute.contamination(docs, items))


def test_op6_plain(spark, docs):
    assert rows(queries.op6_simhash(spark, SF).select("doc_id", "fingerprint", "component_id")) == sorted(brute.near_copies(docs))


def test_op7_held_out(spark, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op7_language(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op9_plain(spark, docs):
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, SF).collect()}
    for doc_id, text in docs:
        spans = brute.private(text)
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        count = Counter(k for k, _, _ in spans)
        row = got[doc_id]
        assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        assert row["base_sha256"] == brute.sha(",".join(joined))
        every = row["spans"].split(",") if row["spans"] else []
        assert [x for x in every if x in joined] == joined
        secrets = {(m.start(1), m.end(1)) for m in re.finditer('"([0-9a-fA-F]{40})"', text)}
        added = {tuple(map(int, x.split(":")[1:])) for x in every if x not in joined}
        assert secrets <= added


def test_op2_finds_what_marks_texts(spark, tmp_path):
    """Held-out accuracy on texts whose label hangs on some words."""
    import random

    rng = random.Random(3)
    calm = ["walk", "tree", "house", "river", "stone", "music", "green", "paper", "under", "seven"]
    texts, labels = [], []
    for i in range(900):
        words = [rng.choice(calm) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words))] = "vile" + rng.choice(["ster", "ness", "ling"])
        texts.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    folder = str(tmp_path)
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    truth = {i: y for i, _, y in labels}
    held = [r for r in queries.op2_toxicity(spark, folder).collect() if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def poisson_count(mean, u):
    term = total = math.exp(-mean)
    k = 0
    while total < u:
        k += 1
        term *= mean / k
        total += term
    return k


def plain_mix(docs, seed="mix-1"):
    """docs as tuples (doc_id, text, source) to (doc_id, text, source, copy, key)."""
    count = Counter(d[2] for d in docs)
    out = []
    for doc_id, text, source in docs:
        rate = len(docs) / len(count) / count[source]
        parts = max(math.ceil(rate / 16), 1)
        ident = "null" if doc_id is None else str(doc_id)
        n = 0
        for j in range(parts):
            u = (int(hashlib.md5(f"{seed}:{ident}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            n += poisson_count(rate / parts, u)
        for k in range(n):
            out.append((doc_id, text, source, k, hashlib.md5(f"{seed}:order:{ident}:{k}".encode()).hexdigest()))
    return out


def plain_cut(text, windows, size=10):
    """Text without spans of contaminated words, and whether it stays."""
    low = text.translate(brute.LOWER)
    found = [(m.start(), m.end(), m[0]) for m in brute.ALNUM.finditer(low)]
    words = [w for _, _, w in found]
    hit = set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
    if len(hit) > 0.5 * len(words):
        return None
    out, at, k = [], 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            if end - k + 1 >= size:
                out.append(text[at : found[k][0]])
                at = found[end][1]
            k = end
        k += 1
    return "".join(out) + text[at:]


def test_pipeline_plain(spark, con):
    table = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    kept = [r for r in table if r[1] and re.search(r"[^\W\d_]", r[1])]
    kept.sort()
    groups, _ = brute.similar_groups([r[:2] for r in kept])
    kept = [r for k, r in enumerate(kept) if groups[k] == k]
    windows = set()
    for _, text in items:
        ws = brute.ALNUM.findall(text.translate(brute.LOWER))
        windows |= {tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9))}
    kept = [(i, plain_cut(t, windows), s) for i, t, s in kept]
    kept = [r for r in kept if r[1] is not None]
    model = pii.train(spark)
    frame = spark.createDataFrame([(i, t) for i, t, _ in kept], "doc_id long, text string")
    spans = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["pii_all"]] for r in pii.spans(frame, model=model).collect()}
    clean = []
    for i, text, source in kept:
        assert [(k, a, b) for a, b, k in spans[i] if k in ("email", "ip", "phone")] == [x for x in brute.private(text) if x[0] != "card"]
        out, at = [], 0
        for a, b, kind in spans[i]:
            if a >= at:
                out.append(text[at:a] + f"[{kind.upper()}]")
            at = max(at, b)
        clean.append((i, "".join(out) + text[at:], source))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "text", "source", "copy", "shuffle_key")
    assert rows(got) == sorted(plain_mix(clean))
    lengths = corpus_pipeline.run(spark, SF).filter("n_chars <> length(text)").count()
    assert lengths == 0


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
