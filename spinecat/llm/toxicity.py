"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

Input of a word: an embedding of the word, the mean embedding of its character n-grams, and how
much more often the word and its n-grams (mean and highest) are found in toxic texts. Both kinds
of embedding are looked up by hash. Two gated recurrent units read a window of ``WINDOW`` words in
either direction; attention weighs their states; a linear layer gives the window's logit. Windows
overlap by half, all of them are scored, and a text has the score of its highest window.

Training (on the driver, Adam): rates of words and n-grams come from one part of the labelled
sample, the network is fitted on the other, so that it sees rates as they are on unseen texts. A
text's label is learned on its highest window so far, which is looked up anew in every other
round. The sample is about ``SAMPLE`` labelled rows, chosen by hash, with texts of at most
``SAMPLE_CHARS`` code points.

A null text, or one without a letter, gets the sample's rate of toxic texts. With no labelled row,
or labels of one class only, every text gets that rate. A repeated id in the labels counts once
for each of its rows. An empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm.language import WORD, Words

SAMPLE = 6000
#: Longer texts are scored like others, but not trained on.
SAMPLE_CHARS = 50_000
WINDOW, STRIDE = 24, 12
#: Hash buckets of the rates, and of the embeddings (the low bits of the same hash).
RATES, EMBEDDINGS = 1 << 18, 1 << 14
LENGTHS = (3, 4, 5)
WORD_SIZE = GRAM_SIZE = 6
INPUT = WORD_SIZE + GRAM_SIZE + 3
HIDDEN = 10
ROUNDS = 8
#: Words a task remembers the inputs of; beyond, it starts anew. Scores are the same either way.
REMEMBERED = 120_000
BATCH = 4096


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of the character n-grams of words, by owner, and each word's own bucket."""
    low = [f"\x02{w.lower()}\x03" for w in words]
    points = np.frombuffer("".join(low).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low)), sizes)
    firsts = np.cumsum(sizes) - sizes
    raw = points * c.mix(np.arange(len(points), dtype=np.uint64) - np.repeat(firsts, sizes).astype(np.uint64) + c.ODD)
    total = np.concatenate([[np.uint64(0)], np.cumsum(raw, dtype=np.uint64)])
    whole = c.mix(total[firsts + sizes] - total[firsts] + sizes.astype(np.uint64))
    owners, buckets = [], []
    for n in LENGTHS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            value = c.mix(value * c.ODD + points[k : k + size])
        inside = owner[:size] == owner[n - 1 :]
        owners.append(owner[:size][inside])
        buckets.append((value[inside] & np.uint64(RATES - 1)).astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return owners[order], buckets[order], (whole & np.uint64(RATES - 1)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """The network's arrays, its pass forward, and its gradients."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "words": normal(EMBEDDINGS, WORD_SIZE, scale=0.1),
            "grams": normal(EMBEDDINGS, GRAM_SIZE, scale=0.1),
            "attend_w": normal(2 * HIDDEN, HIDDEN, scale=0.3),
            "attend_b": np.zeros(HIDDEN, np.float32),
            "attend_v": normal(HIDDEN, scale=0.3),
            "out_w": normal(2 * HIDDEN, scale=0.3),
            "out_b": np.full(1, -2, np.float32),
        }
        for d in ("f", "b"):
            self.p[f"w{d}"] = normal(INPUT, 3 * HIDDEN, scale=INPUT**-0.5)
            self.p[f"u{d}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"bias{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.word_rate = np.zeros(RATES, np.float32)
        self.gram_rate = np.zeros(RATES, np.float32)

    def inputs(self, words: list[str]):
        """Input of each word, and what the gradients of the embeddings need."""
        owners, buckets, own = grams(words)
        firsts = np.searchsorted(owners, np.arange(len(words)))
        counts = np.diff(np.append(firsts, len(owners)))[:, None].astype(np.float32)
        rates = self.gram_rate[buckets]
        x = np.concatenate(
            [
                self.p["words"][own % EMBEDDINGS],
                np.add.reduceat(self.p["grams"][buckets % EMBEDDINGS], firsts, axis=0) / counts,
                self.word_rate[own][:, None],
                np.add.reduceat(rates, firsts)[:, None] / counts,
                np.maximum.reduceat(rates, firsts)[:, None],
            ],
            axis=1,
        )
        return x.astype(np.float32), (owners, buckets, own, counts)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of each word for both directions; the last row is for padding and keeps the state."""
        out = np.concatenate([x @ self.p["wf"] + self.p["biasf"], x @ self.p["wb"] + self.p["biasb"]], axis=1)
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[:, :HIDDEN] = pad[:, 3 * HIDDEN : 4 * HIDDEN] = 40
        return np.concatenate([out, pad])

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers; the padding is the last row of the gates."""
        n, size = ids.shape
        states = np.empty((size, n, 2 * HIDDEN), np.float32)
        trace = {"f": [], "b": []}
        for d, shift, order in (("f", 0, range(size)), ("b", 3 * HIDDEN, range(size - 1, -1, -1))):
            u = self.p[f"u{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            own = gates[:, shift : shift + 3 * HIDDEN]
            at = 0 if d == "f" else HIDDEN
            for t in order:
                x, hu = own[ids[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                after = new + z * (h - new)
                if keep:
                    trace[d].append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
                states[t, :, at : at + HIDDEN] = h = after
        mid = np.tanh(states @ self.p["attend_w"] + self.p["attend_b"])
        weight = mid @ self.p["attend_v"]
        weight[(ids == len(gates) - 1).T] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ self.p["out_w"] + self.p["out_b"]
        return (logit, (states, mid, weight, pooled, trace)) if keep else logit

    def gradients(self, x: np.ndarray, made, ids: np.ndarray, y: np.ndarray):
        gates = self.project(x)
        logit, (states, mid, weight, pooled, trace) = self.forward(gates, ids, keep=True)
        n = len(y)
        g = {}
        up = ((_sigmoid(logit) - y) / n).astype(np.float32)
        g["out_w"], g["out_b"] = pooled.T @ up, up.sum(keepdims=True)
        d_pooled = up[:, None] * self.p["out_w"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_mid = d_score[:, :, None] * self.p["attend_v"] * (1 - mid**2)
        g["attend_v"] = np.einsum("tn,tnk->k", d_score, mid)
        g["attend_w"] = np.einsum("tnk,tnj->kj", states, d_mid)
        g["attend_b"] = d_mid.sum(axis=(0, 1))
        d_states += d_mid @ self.p["attend_w"].T
        d_gates = np.zeros_like(gates)
        for d, shift, at in (("f", 0, 0), ("b", 3 * HIDDEN, HIDDEN)):
            u = self.p[f"u{d}"]
            g[f"u{d}"] = np.zeros_like(u)
            back = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, new, hu in reversed(trace[d]):
                back = back + d_states[t, :, at : at + HIDDEN]
                d_new = back * (1 - z) * (1 - new**2)
                d_z = back * (h - new) * z * (1 - z)
                d_r = d_new * hu * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"u{d}"] += h.T @ d_hu
                np.add.at(d_gates[:, shift : shift + 3 * HIDDEN], ids[:, t], d_x)
                back = back * z + d_hu @ u.T
        d_gates = d_gates[:-1]
        g["wf"], g["wb"] = x.T @ d_gates[:, : 3 * HIDDEN], x.T @ d_gates[:, 3 * HIDDEN :]
        g["biasf"], g["biasb"] = d_gates[:, : 3 * HIDDEN].sum(axis=0), d_gates[:, 3 * HIDDEN :].sum(axis=0)
        d_x = d_gates[:, : 3 * HIDDEN] @ self.p["wf"].T + d_gates[:, 3 * HIDDEN :] @ self.p["wb"].T
        owners, buckets, own, counts = made
        g["words"], g["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(g["words"], own % EMBEDDINGS, d_x[:, :WORD_SIZE])
        np.add.at(g["grams"], buckets % EMBEDDINGS, (d_x[:, WORD_SIZE : WORD_SIZE + GRAM_SIZE] / counts)[owners])
        return logit, g


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word (within the row) of every window; a row without words has none."""
    counts = np.where(sizes > 0, 1 + np.maximum(-(-(sizes - WINDOW) // STRIDE), 0), 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    return rows, (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def window_ids(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, firsts: np.ndarray, pad: int) -> np.ndarray:
    """Word numbers of windows, padded at the end of a row."""
    starts = np.cumsum(sizes) - sizes
    inside = firsts[:, None] + np.arange(WINDOW)
    at = np.minimum(starts[rows][:, None] + inside, max(len(ids) - 1, 0))
    return np.where(inside < sizes[rows][:, None], ids[at], pad)


def score_windows(net: Net, gates: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
    """(row, first word, logit) of every window."""
    rows, firsts = windows(sizes)
    out = np.empty(len(rows), np.float32)
    for a in range(0, len(rows), BATCH):
        part = window_ids(ids, sizes, rows[a : a + BATCH], firsts[a : a + BATCH], len(gates) - 1)
        out[a : a + BATCH] = net.forward(gates, part)
    return rows, firsts, out


def _highest(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the highest value and its place (the first of equals); -1 for rows without."""
    top = np.full(n, -np.inf, np.float32)
    np.maximum.at(top, rows, values)
    place = np.full(n, -1, dtype=np.int64)
    hit = np.flatnonzero(values == top[rows])[::-1]
    place[rows[hit]] = hit
    return top, place


#: Words whose n-grams are held at a time.
CHUNK = 20_000


def _grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each word in the n-gram buckets (one more at the end), these, and own buckets."""
    counts, buckets, owns = [], [], []
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        owners, found, own = grams(part)
        counts.append(np.bincount(owners, minlength=len(part)))
        buckets.append(found.astype(np.int32))
        owns.append(own.astype(np.int32))
    return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(buckets), np.concatenate(owns)


def _gates_of(net: Net, words: list[str]) -> np.ndarray:
    """Gate inputs of words, and of the padding after them."""
    parts = [net.project(net.inputs(words[at : at + CHUNK])[0]) for at in range(0, len(words), CHUNK)]
    return np.concatenate([*(x[:-1] for x in parts[:-1]), parts[-1]])


def _rates(net: Net, texts: list[np.ndarray], y: np.ndarray, made) -> None:
    """Log ratio of the toxic share of texts with a word (n-gram) to the overall share, shrunk."""
    first, buckets, own = made
    share = max(float(y.mean()), 1e-6)
    counts = {name: (np.zeros(RATES), np.zeros(RATES)) for name in ("word_rate", "gram_rate")}
    for ids, label in zip(texts, y.tolist(), strict=True):
        distinct = np.unique(ids)
        sizes = first[distinct + 1] - first[distinct]
        at = np.repeat(first[distinct] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        for name, found in (("word_rate", own[distinct]), ("gram_rate", buckets[at])):
            hits, alls = counts[name]
            found = np.unique(found)
            alls[found] += 1
            hits[found] += label
    for name, (hits, alls) in counts.items():
        setattr(net, name, (np.log((hits + 8 * share) / (alls + 8)) - np.log(share)).astype(np.float32))


def fit(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> dict:
    """Network and rate of toxic texts from labelled texts."""
    rate = (float(y.sum()) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return {"net": None, "rate": rate}
    rng = np.random.default_rng(seed)
    words = Words()
    ids = [np.fromiter(map(words.__getitem__, WORD.findall(t)), np.int64) for t in texts]
    net = Net(seed)
    made = _grams_of(words.new)
    first = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        first[rng.permutation(own)[: -(-len(own) // 2)]] = True
    _rates(net, [ids[k] for k in np.flatnonzero(first)], y[first], made)
    rest = np.array([k for k in np.flatnonzero(~first) if len(ids[k])], dtype=np.int64)
    if len(rest) and len(set(y[rest].tolist())) == 2:
        _train(net, words, [ids[k] for k in rest], y[rest], rounds, rng)
    _rates(net, ids, y, made)
    return {"net": net, "rate": rate}


def _train(net: Net, words: Words, ids: list[np.ndarray], y: np.ndarray, rounds: int, rng) -> None:
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    rows, firsts = windows(sizes)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, best = 0, None
    pool = window_ids(flat, sizes, rows, firsts, len(words)).astype(np.int32)
    tell = [net.inputs(words.new[at : at + CHUNK])[0][:, [-1, -3]].sum(axis=1) for at in range(0, len(words), CHUNK)]
    peaks = np.append(np.concatenate(tell), -9.0)  # first windows: those with the most telling word
    _, best = _highest(rows, peaks[pool].max(axis=1).astype(np.float32), len(sizes))
    for turn in range(rounds):
        if turn % 2:
            gates = _gates_of(net, words.new)
            logits = np.concatenate([net.forward(gates, pool[a : a + BATCH]) for a in range(0, len(pool), BATCH)])
            _, best = _highest(rows, logits, len(sizes))
        size = 32 if len(y) < 1000 else 64
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            step += 1
            own = pool[best[part]]
            used, local = np.unique(own, return_inverse=True)
            real = used < len(words)
            names = [words.new[k] for k in used[real].tolist()]
            x, made = net.inputs(names)
            # Padding sorts last, as it has the highest number.
            _, grads = net.gradients(x, made, local.reshape(own.shape), y[part].astype(np.float32))
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """Fits on about ``sample`` labelled rows that are not held out, chosen by hash; all if there are fewer.

    Equal label rows count once, and of several texts of one id the least is learned from, so
    neither can make the sample longer.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("i_"), F.col(label_col).cast("double").alias("y_")
    )
    known = known.distinct()
    picked = known.filter(c.in_share(F.xxhash64("i_", "y_"), sample / max(known.count(), 1)))
    texts = docs.select(F.col(id_col).alias("i_"), F.col(text_col).alias("t_")).filter(F.length(text_col) <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(picked), "i_")  # about ``sample`` different rows of two numbers
    got = sorted((r[0], r[1], r[2]) for r in rows.groupBy("i_", "y_").agg(F.min("t_").alias("t_")).select("i_", "t_", "y_").collect())
    if not got:
        return {"net": None, "rate": 0.0}
    return fit([r[1] for r in got], np.array([r[2] for r in got]))


def held_out(column: Column | str) -> Column:
    """Rows that are not learned from: crc32 of the id's text modulo 5 is 0. A null id is not one."""
    return F.coalesce(c.crc_remainder(column, 5) == 0, F.lit(False))


class Scorer:
    """Scores texts; remembers the gate inputs of words."""

    def __init__(self, model: dict):
        self.net, self.rate = model["net"], model["rate"]
        self.reset()

    def reset(self) -> None:
        self.words, self.gates = Words(), None

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.rate)
        if self.net is None:
            return out
        found = [WORD.findall(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        lookup = self.words.__getitem__
        ids = np.fromiter(map(lookup, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        if not len(ids):
            return out
        new, self.words.new = self.words.new, []
        if new:
            gates = _gates_of(self.net, new)
            self.gates = gates if self.gates is None else np.concatenate([self.gates[:-1], gates])
        rows, _, logits = score_windows(self.net, self.gates, ids, sizes)
        top, place = _highest(rows, logits, len(texts))
        some = place >= 0
        out[some] = _sigmoid(top[some].astype(np.float64))
        if len(self.words) > REMEMBERED:
            self.reset()
        return out


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every text."""
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, _, _ in c.slices(batch, "text_"):
                texts = pc.fill_null(part.column(1).cast(pa.string()), "").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(texts))], ["id_", "score"])

    kind = rows.schema["id_"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id_ {kind}, score double").select(F.col("id_").alias(id_col), "score")
