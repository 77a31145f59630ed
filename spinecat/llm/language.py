"""Language identification of whole texts, with spans for mixed ones.

Learning: for every language of the labelled rows, counts of hashed character n-grams (lengths 1
to 4, word borders included) over all words, and of letters by script. Counting covers every
labelled row; a task sends at most BUCKETS counts a language.

Scoring: words are letters with the marks on them (Unicode categories L and M). A word's script range leaves only the languages that write at
least ``SCRIPT_SHARE`` of their letters in it (all, if none does). Each of those gets the word's
naive Bayes log score, scaled by the number of n-gram lengths and normalised. Viterbi then finds
the best sequence of languages, a change costing ``switch``; runs of one language are the spans.
The document's language is, of those with a span, the most likely over all words, where no word
counts more than ``FLOOR`` against a language (ties: the first by name); its score is its share of
the letters times its posterior.

A null text or one without a letter is ``und`` with score 0 and no spans. With nothing to learn
from, every text is ``und``. Repeated ids are judged row by row. An empty table gives no rows.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3, 4)
SCRIPT_SHARE = 0.01
FLOOR = -8.0
#: Words a task remembers the scores of; beyond, it starts anew. Scores are the same either way.
REMEMBERED = 200_000
SLICE = 3_000_000
#: Words whose n-grams are held at a time: some 40 of them a word, in several arrays.
AT_ONCE = 10_000


_CATEGORY = [unicodedata.category(chr(x)) for x in range(0x110000)]


def _class(*kinds: str) -> str:
    """The code points of some Unicode categories, as ranges of a character class."""
    points = np.flatnonzero([x.startswith(kinds) for x in _CATEGORY])
    breaks = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.append(0, breaks + 1)], points[np.append(breaks, len(points) - 1)]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))


#: A letter, then letters and the marks on them; numerals such as one half are no letters.
WORD = re.compile(f"[{_class('L')}][{_class('L', 'M')}]*")
#: The same words, found faster, for texts without marks and such numerals.
PLAIN_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.array([x.startswith(("Nl", "No", "M")) for x in _CATEGORY])


def pattern(text: str) -> re.Pattern:
    if text.isascii() or not _ODD[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any():
        return PLAIN_WORD
    return WORD


#: First code point of each range of scripts, in order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_FIRST = np.array([x for x, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(x) for _, x in SCRIPTS])


class Words(dict):
    """Numbers the distinct words as they come; ``new`` are those since the last look."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words, lower-cased, and each word's script."""
    low = [w.lower() for w in words]
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in low).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low)), sizes)
    scripts = _SCRIPT[np.searchsorted(_FIRST, points[np.cumsum(sizes) - sizes + 1].astype(np.int64), side="right") - 1]
    owners, buckets = [], []
    for n in LENGTHS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            value = c.mix(value * c.ODD + points[k : k + size])
        whole = owner[:size] == owner[n - 1 :]
        owners.append(owner[:size][whole])
        buckets.append((value[whole] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets), scripts


def learn(rows: DataFrame, text_col: str, label_col: str) -> dict:
    """Counts over all rows with a label: languages, n-gram log scores and allowed scripts."""
    labelled = rows.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang_"), F.col(text_col).alias("text_")
    )
    langs = sorted(r[0] for r in labelled.select("lang_").distinct().collect())  # the label set
    number = {x: i for i, x in enumerate(langs)}
    shared = rows.sparkSession.sparkContext.broadcast(number)
    width = BUCKETS + len(SCRIPT_NAMES)

    def count(batches):
        number = shared.value
        total = np.zeros((len(number), width))
        for part in (part for batch in batches for part, _, _ in c.slices(batch, "text_", SLICE)):
            tags = part.column(0).to_pylist()
            texts = pc.fill_null(part.column(1).cast(pa.string()), "").to_pylist()
            words, seen = Words(), [[] for _ in number]
            for tag, text in zip(tags, texts, strict=True):
                seen[number[tag]].extend(map(words.__getitem__, pattern(text).findall(text)))
            if not words:
                continue
            times = {k: np.bincount(ids, minlength=len(words)) for k, ids in enumerate(seen) if ids}
            for at in range(0, len(words), AT_ONCE):
                new = words.new[at : at + AT_ONCE]
                owners, buckets, scripts = features(new)
                sizes = np.fromiter(map(len, new), np.int64, len(new))
                for k, all_ in times.items():
                    own = all_[at : at + AT_ONCE]
                    total[k, :BUCKETS] += np.bincount(buckets, weights=own[owners], minlength=BUCKETS)
                    total[k, BUCKETS:] += np.bincount(scripts, weights=own * sizes, minlength=len(SCRIPT_NAMES))
        lang, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(place), pa.array(total[lang, place].astype(np.int64))], ["lang", "place", "n"]
        )

    counts = np.zeros((len(langs), width))
    summed = labelled.mapInArrow(count, "lang long, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # at most BUCKETS rows a language
    counts[got["lang"].to_numpy(), got["place"].to_numpy()] = got["n"].to_numpy()
    grams, letters = counts[:, :BUCKETS], counts[:, BUCKETS:]
    smooth = grams + 0.5
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) / len(LENGTHS) if langs else np.zeros((0, BUCKETS))
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return {"langs": langs, "logs": np.ascontiguousarray(logs.T, dtype=np.float32), "scripts": share >= SCRIPT_SHARE}


def letters_only() -> dict:
    """A model of one language, ``any``: a text with a letter gets it, others are ``und``."""
    return {
        "langs": ["any"],
        "logs": np.zeros((BUCKETS, 1), dtype=np.float32),
        "scripts": np.ones((1, len(SCRIPT_NAMES)), dtype=bool),
    }


class Scorer:
    """Log scores of words, remembered by word."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.words = Words()
        self.scores = np.zeros((0, len(self.model["langs"])), dtype=np.float32)

    def update(self) -> None:
        new, self.words.new = self.words.new, []
        parts = [self.scores]
        for at in range(0, len(new), AT_ONCE):
            parts.append(self._score(new[at : at + AT_ONCE]))
        self.scores = np.concatenate(parts)

    def _score(self, words: list[str]) -> np.ndarray:
        owners, buckets, scripts = features(words)
        order = np.argsort(owners, kind="stable")
        first = np.searchsorted(owners[order], np.arange(len(words)))
        raw = np.add.reduceat(self.model["logs"][buckets[order]], first, axis=0)
        allowed = self.model["scripts"][:, scripts].T
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        raw = np.where(allowed, raw, -1e4)
        top = raw.max(axis=1, keepdims=True)
        return (raw - top - np.log(np.exp(raw - top).sum(axis=1, keepdims=True))).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; the texts advance together, longest first."""
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(scores):
        return labels
    best = scores.argmax(axis=1)
    # A text whose words all prefer one language has that as its best sequence.
    head = np.repeat(best[np.minimum(starts, len(scores) - 1)], sizes)
    alike = np.ones(len(starts), dtype=bool)
    alike[np.repeat(np.arange(len(starts)), sizes)[best != head]] = False
    labels[:] = head
    rest = np.flatnonzero(~alike)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    if not len(rest):
        return labels
    begin, size = starts[rest], sizes[rest]
    left = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t
    back = np.zeros(scores.shape, dtype=np.int16)
    now = scores[begin].astype(np.float64)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, int(size[0])):
        n = left[t]
        now_ = now[:n]
        top = now_.argmax(axis=1)
        jump = now_[np.arange(n), top][:, None] - switch
        stay = now_ >= jump
        at = begin[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        now[:n] = np.where(stay, now_, jump) + scores[at]
    state = now.argmax(axis=1).astype(np.int16)
    for t in range(int(size[0]) - 1, -1, -1):
        n = left[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def _judge(scorer: Scorer, texts: list[str], switch: float):
    words = [pattern(x).findall(x) for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lookup = scorer.words.__getitem__
    flat = list(chain.from_iterable(words))
    ids = np.fromiter(map(lookup, flat), np.int64, len(flat))
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    del words, flat
    scorer.update()
    starts = np.cumsum(sizes) - sizes
    scores = scorer.scores[ids]
    labels = viterbi(scores, starts, sizes, switch)
    n, k = len(texts), scores.shape[1]
    rows = np.repeat(np.arange(n), sizes)
    weight = np.bincount(rows * k + labels, weights=letters, minlength=n * k).reshape(n, k)
    limited = np.maximum(scores, FLOOR)
    total = np.stack([np.bincount(rows, weights=limited[:, j], minlength=n) for j in range(k)], axis=1)
    lang = np.where(weight > 0, total, -np.inf).argmax(axis=1)
    share = weight[np.arange(n), lang] / np.maximum(weight.sum(axis=1), 1)
    gap = np.exp(total - total.max(axis=1, keepdims=True))
    score = share * (gap[np.arange(n), lang] / gap.sum(axis=1))
    return sizes, starts, labels, lang, score


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    found = [m.span() for m in pattern(text).finditer(text)]
    edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(found)]
    return [
        {"start": found[a][0], "end": found[b - 1][1], "lang": langs[labels[a]]}
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


SPANS = "array<struct<start:int,end:int,lang:string>>"


def label(
    docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, switch: float = 6.0, spans: bool = False
) -> DataFrame:
    """The kept columns of docs (all by default) as struct ``row``, lang_pred, score and, if asked, spans."""
    keep = docs.columns if keep is None else keep
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    flat = docs.toDF(*names.values()).select(*dict.fromkeys([*(names[x] for x in keep), names[text_col]]))
    kept, text = [names[x] for x in keep], names[text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = model["langs"]
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def scan(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, _, _ in c.slices(batch, text, SLICE):
                texts = pc.fill_null(part.column(part.schema.get_field_index(text)).cast(pa.string()), "").to_pylist()
                if langs:
                    sizes, starts, labels, lang, score = _judge(scorer, texts, switch)
                else:
                    sizes, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
                names_ = [langs[lang[i]] if sizes[i] else "und" for i in range(len(texts))]
                out = [*(part.column(part.schema.get_field_index(x)) for x in kept), pa.array(names_, pa.string()), pa.array(np.where(sizes > 0, score, 0.0))]
                if spans:
                    own = [
                        _spans(texts[i], labels[starts[i] : starts[i] + sizes[i]], langs) if sizes[i] else []
                        for i in range(len(texts))
                    ]
                    out.append(pa.array(own, span_kind))
                if len(scorer.words) > REMEMBERED:
                    scorer.reset()
                yield pa.RecordBatch.from_arrays(out, [*kept, "lang_pred", "score", *(["spans"] if spans else [])])

    schema = "".join(f"{k} {flat.schema[k].dataType.simpleString()}, " for k in kept) + "lang_pred string, score double"
    back = F.struct(*[F.col(names[x]).alias(x) for x in keep]).alias("row")
    done = flat.mapInArrow(scan, schema + (f", spans {SPANS}" if spans else ""))
    return done.select(back, "lang_pred", "score", *(["spans"] if spans else []))


def held_out(column: Column | str) -> Column:
    """Rows that are not learned from: crc32 of the id's text modulo 4 is 2. A null id is not one."""
    return F.coalesce(c.crc_remainder(column, 4) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    return learn(docs.filter(~held_out(id_col)), text_col, lang_col)
