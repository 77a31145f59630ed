"""Personal data: rule spans, and candidate spans that boosted trees accept. Spark columns only.

Rules find emails, IPs, cards and phone numbers (leftmost, non-overlapping per kind; matches that
fail a check are dropped). Generators then propose further spans with high recall, several of
which may overlap: digit groups, card numbers glued to their neighbours, account numbers, long
mixed tokens and written-out addresses. Boosted trees score each one from its format and its
context; a calibrated threshold for each generator (the least score that keeps ``PRECISION`` on
held-out examples) decides. Of overlapping accepted spans the better scored stays; a span that
overlaps a rule span goes.

The trees are fitted on the driver from at most ``EXAMPLES`` made-up sentences of labelled kinds,
passed through the same generators and features. Scoring is one expression over the arrays of a
row: no shuffle, no Python on the executors.

Patterns start at the border of a run of their characters (or at the end of the last match) and
repeat groups without bound only possessively, which Java runs as a loop, so long runs of digits,
letters or domain labels cost linear time and no stack.

A null text is empty and has no spans. Repeated ids are judged row by row. An empty table gives no
rows. Other columns are kept by ``redact``, and by ``spans`` but for those it adds by name
(pii_base, pii_all).
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat.llm import trees

KINDS = ("email", "ip", "card", "phone", "secret", "account", "contact", "number")
EXAMPLES = 3000
PRECISION = 0.95
SPAN = "struct<start:int,end:int,kind:string,text:string>"

EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of the method: kind and pattern.
GENERATORS = (
    ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    (
        "contact",
        r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,60}\x20?[\[(]?(?:at|AT)[\])]?\x20?[A-Za-z0-9-]{2,60}"
        r"\x20?[\[(]?(?:dot|DOT)[\])]?\x20?[A-Za-z]{2,10}(?![A-Za-z0-9])",
    ),
    ("number", r"(?<![0-9+.])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans (code points, end exclusive) of a pattern's matches, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["own"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["own"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["done"], F.array(span)).alias("done"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("own"))
    pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["own"].alias("own")))
    spans = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("done")), step, lambda acc: acc["done"]
    )
    return F.when(text.rlike(pattern), spans).otherwise(none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)
    each = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def add(acc, i):
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(each, F.lit(0), add) % 10 == 0


def _pieces(run: Column) -> Column:
    """Parts of a digit run between two or more separators, without a trailing one, as spans."""
    parts = F.split(run["text"], r"[\x20-]{2,}", -1)
    seps = F.regexp_extract_all(run["text"], F.lit(r"[\x20-]{2,}"), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, i):
        part = F.element_at(parts, i)
        own = F.regexp_replace(part, r"[\x20-]+$", "")
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(own)).alias("end"), F.lit("card").alias("kind"), own.alias("text"))
        gap = F.when(i <= F.size(seps), F.length(F.try_element_at(seps, i))).otherwise(0)
        return F.struct((end + gap).alias("at"), F.concat(acc["done"], F.array(span)).alias("done"))

    start = F.struct(run["start"].alias("at"), none.alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step, lambda acc: acc["done"])


def rule_spans(text: Column) -> Column:
    """Array of the rules' spans, by start, then kind."""

    def ip_ok(x):
        parts = F.transform(F.split(x["text"], r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))

    def card_ok(x):
        number = digits(x["text"])
        return F.length(number).between(12, 19) & luhn(number)

    def phone_ok(x):
        return F.length(digits(x["text"])).between(9, 15)

    none = F.array().cast(f"array<{SPAN}>")
    runs = F.filter(matches(text, DIGIT_RUN, "run"), lambda x: F.length(x["text"]) >= 12)
    cards = F.filter(F.flatten(F.transform(runs, _pieces)), card_ok)
    cards = F.when(text.rlike(r"[0-9][0-9\x20-]{10,}"), cards).otherwise(none)
    found = F.concat(
        matches(text, EMAIL, "email"),
        F.filter(matches(text, IP, "ip"), ip_ok),
        cards,
        F.filter(matches(text, PHONE, "phone"), phone_ok),
    )
    return _by_start(found)


def _by_start(spans: Column) -> Column:
    rank = _strings(list(KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), F.array_position(rank, x["kind"]).alias("b"), x.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


CONTEXT = 24
WORDS = {
    "secret": "key|token|secret|passw|pwd|auth|bearer|credential",
    "account": "iban|account|konto|cuenta|compte|bank",
    "number": "ssn|social|tel|phone|call|fax|mobil|cell|passport|card",
    "other": "isbn|version|order|invoice|article|page|date|line|commit|sha|build|chapter|section|no\\.|ref",
}
FEATURES = 18


def features(span: Column, text: Column) -> list[Column]:
    """Format and context numbers of a candidate, in a fixed order."""
    own = span["text"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    low = F.lower(before)
    last, after = F.substring(before, -1, 1), F.substring(text, span["end"] + 1, F.lit(1))

    def flag(x):
        return F.coalesce(x, F.lit(False)).cast("double")

    def count(pattern):
        return (F.length(own) - F.length(F.regexp_replace(own, pattern, ""))).cast("double")

    number = digits(own)
    return [
        *(flag(span["kind"] == k) for k in ("secret", "account", "contact", "number", "card")),
        F.length(own).cast("double"),
        count("[0-9]"),
        count("[A-Z]"),
        count("[a-z]"),
        count(r"[\x20./()-]"),
        F.size(F.split(own, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")).cast("double"),
        flag((F.length(number) > 0) & luhn(number)),
        *(flag(low.rlike(WORDS[k])) for k in ("secret", "account", "number", "other")),
        flag(last.rlike("[\"'=:]")),
        flag(after.rlike("[\"';]")),
    ]


def candidates(text: Column, base: Column) -> Column:
    """Proposed spans that overlap no rule span; they may overlap one another."""
    found = F.concat(*[matches(text, pattern, kind) for kind, pattern in GENERATORS])
    return F.filter(
        found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )


def _example(rng: random.Random) -> tuple[str, str, int]:
    """(sentence, the span's text, whether it is personal)."""

    def num(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def mixed(n, letters):
        return "".join(rng.choice(letters) for _ in range(n))

    def word():
        return "".join(rng.choice("abcdefghiklmnoprstuvwé") for _ in range(rng.randint(2, 9)))

    def card(valid):
        body = num(rng.choice((12, 14, 15, 15, 15, 18)))
        total = sum(int(d) if i % 2 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(body)))
        check = -total % 10
        return body + str(check if valid else (check + rng.randint(1, 9)) % 10)

    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    quote = rng.choice(('"', "'", ""))
    positive = rng.random() < 0.5
    kind = rng.choice(("secret", "secret", "account", "contact", "number", "card", "card"))
    if kind == "secret" and positive:
        own = mixed(rng.choice((24, 32, 40, 40, 64)), rng.choice((hexes, hexes.upper(), b64)))
        lead = rng.choice(("token = ", "api_key=", "secret: ", "password = ", "Authorization: Bearer ", "key: "))
        return f"{word()} {lead}{quote}{own}{quote} {word()}", own, 1
    if kind == "secret":
        own = rng.choice((
            lambda: mixed(rng.randint(20, 40), "abcdefghijklmnopqrstuvwxyz"),
            lambda: "-".join(w for w in (word().replace("é", "e") for _ in range(6))),
            lambda: mixed(rng.randint(20, 40), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            lambda: "/".join(word().replace("é", "e") for _ in range(6)),
            lambda: mixed(rng.choice((32, 40)), hexes),
        ))()
        lead = rng.choice(("commit ", "sha ", "build ", "", "", "in ", "the "))
        return f"{word()} {lead}{own} {word()}", own, 0
    if kind == "account":
        own = rng.choice("DEFRGBES") + rng.choice("ERBS") + num(2) + num(rng.choice((14, 16, 18)))
        own = own if rng.random() < 0.5 else " ".join(own[i : i + 4] for i in range(0, len(own), 4))
        lead = rng.choice(("IBAN ", "account ", "Konto: ", "bank ")) if positive else rng.choice(("ref ", "order ", "article ", "no. "))
        return f"{word()} {lead}{own}, {word()}", own, int(positive)
    if kind == "contact":
        user, host = word().replace("é", "e") + num(rng.randint(0, 2)), word().replace("é", "e")
        if positive:
            own = rng.choice((f"{user} [at] {host} [dot] com", f"{user}(at){host}(dot)org", f"{user} (at) {host} (dot) net"))
            return f"{word()} {own} {word()}", own, 1
        own = f"{user} at {host} dot {word().replace('é', 'e')}"
        return f"{word()} {own} {word()}", own, 0
    if kind == "number":
        if positive:
            own = rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"))
            lead = rng.choice(("call ", "tel ", "phone: ", "SSN ", "mobile ", "fax ", "Tel. "))
            return f"{word()} {lead}{own} {word()}", own, 1
        own = rng.choice((f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}-{num(2)}-{num(5)}", f"{num(2)} {num(3)} {num(3)}"))
        lead = rng.choice(("date ", "ISBN ", "page ", "version ", "", "", "order "))
        return f"{word()} {lead}{own} {word()}", own, 0
    own = card(positive)
    return f"{word()} {num(16) if rng.random() < 0.3 else word()} {own} {word()}", own, int(positive)


def train(spark: SparkSession, examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 7):
    """Trees and a threshold per generator, from made-up sentences passed through the generators."""
    rng = random.Random(seed)
    made = [_example(rng) for _ in range(examples)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(made)], "n int, text string, own string, label int")
    base = rows.withColumn("base", rule_spans(F.col("text"))).withColumn("found", candidates(F.col("text"), F.col("base")))
    flat = base.select("n", "text", "own", "label", F.explode("found").alias("span"))
    got = flat.select(
        "n",
        F.col("span.kind").alias("kind"),
        ((F.col("label") == 1) & (F.col("span.text") == F.col("own"))).cast("double").alias("y"),
        F.array(*features(F.col("span"), F.col("text"))).alias("x"),
    ).collect()
    x = np.array([r["x"] for r in got])
    y = np.array([r["y"] for r in got])
    fit = np.array([r["n"] % 3 != 0 for r in got])
    model = trees.fit(x[fit], y[fit])
    scores = model.score(x)
    limits = {}
    for kind, _ in GENERATORS:
        own = np.array([r["kind"] == kind for r in got]) & ~fit
        limits[kind] = trees.threshold(scores[own], y[own], precision)
    return model, limits


def accepted(text: Column, base: Column, found: Column, model, limits: dict) -> Column:
    """Candidates at or above their threshold; of overlapping ones the best, then the longest, stays."""
    limit = F.lit(2.0)
    scored = F.transform(
        found,
        lambda x: F.struct(
            (-model.column([f for f in features(x, text)])).alias("worse"),
            (x["start"] - x["end"]).alias("size"),
            x.alias("span"),
        ),
    )
    del base

    def passes(x):
        least = limit
        for kind, value in limits.items():
            least = F.when(x["span"]["kind"] == kind, F.lit(value)).otherwise(least)
        return -x["worse"] >= least

    none = F.array().cast(f"array<{SPAN}>")

    def take(acc, x):
        span = x["span"]
        free = ~F.exists(acc, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return F.when(free, F.concat(acc, F.array(span))).otherwise(acc)

    return F.aggregate(F.array_sort(F.filter(scored, passes)), none, take)


def spans(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """docs with pii_base (the rules' spans) and pii_all (with the accepted ones), by start and kind."""
    model, limits = model or train(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = docs.withColumn("pii_base", rule_spans(text))
    step = step.withColumn("pii_found_", candidates(text, F.col("pii_base")))
    added = accepted(text, F.col("pii_base"), F.col("pii_found_"), model, limits)
    none = F.size("pii_found_") == 0
    every = F.when(none, F.col("pii_base")).otherwise(_by_start(F.concat("pii_base", added)))
    return step.withColumn("pii_all", every).drop("pii_found_")


def joined(column: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    parts = F.transform(F.col(column), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def counted(column: str, kind: str) -> Column:
    return F.size(F.filter(F.col(column), lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """docs with every span of the text replaced by [KIND]; overlapping spans become one."""
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    found = spans(docs.toDF(*names.values()), names[text_col], model)
    whole = F.col(names[text_col])

    def step(acc, x):
        gap = F.substr(whole, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        done = F.when(x["start"] < acc["at"], acc["done"]).otherwise(F.concat(acc["done"], gap, mark))
        return F.struct(done.alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    text = F.aggregate(
        "pii_all",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        step,
        lambda acc: F.concat(acc["done"], F.substr(whole, acc["at"] + 1, F.length(whole))),
    )
    clean = F.when(F.size("pii_all") == 0, whole).otherwise(text)
    return found.withColumn(names[text_col], clean).select(*[F.col(v).alias(k) for k, v in names.items()])
