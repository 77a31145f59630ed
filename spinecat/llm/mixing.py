"""Mixing sources to target weights by Poisson replication.

A source with weight w of the total weight gets the mean repetition rate
``size * documents * w / its documents``. Each document's count is the inverse of the Poisson
distribution of that mean at a uniform number that md5 derives from the seed and the id, so a run
can be repeated and needs no state. The document is exploded by its count, and the copies are
dealt out and ordered by an md5 key of (seed, id, copy), which shuffles the whole corpus.

Means above ``SPLIT`` are dealt into equal parts that are inverted on their own and added, as the
sum of Poisson numbers is one; so the tail sums never underflow and are never cut short.

A null source is a source of its own. Rows that share an id, or have none, are numbered in the
order of their other columns, over ranges; the number is part of what is hashed, so that every row
has its own count and its own place. Sources that the weights do not name get the weight ``other``
(0 drops them). An empty table gives no rows. Columns named copy or shuffle_key give way to the new
ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinecat.llm import common as c
from spinecat.operators.joins import join_unique
from spinecat.operators.pages import numbered

SEED = "mix-1"
SPLIT = 16.0
#: Summands of a part; beyond, less than 1e-60 of the distribution is left.
TERMS = 128
#: Copy numbers made at a time.
PIECE = 1_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, in steps of 2^-52."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_sums(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, ... TERMS - 1, for means up to SPLIT."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def step(acc, k):
        term = acc["term"] * mean / k
        total = F.element_at(acc["sums"], -1) + term
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), zero, step, lambda acc: acc["sums"])


def poisson(sums: Column, u: Column) -> Column:
    """Least k whose probability of at most k reaches u."""
    return F.size(F.filter(sums, lambda x: x < u))


def rates(docs: DataFrame, source_col: str, weights: dict | None, size: float, other: float) -> DataFrame:
    """source_key, mean repetition rate, its equal parts and the Poisson sums of a part, by source."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    counts = docs.groupBy(key.alias("source_key")).agg(F.count("*").alias("n"))
    weight = F.lit(1.0 if weights is None else other)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source_key") == ("" if name is None else f"s{name}"), float(value)).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    total = weighted.agg(F.sum("n"), F.sum("weight")).first()  # one row
    documents, weights_sum = total[0] or 0, total[1] or 0.0
    share = F.col("weight") / F.lit(float(weights_sum or 1.0))
    rated = weighted.select("source_key", (F.lit(float(size) * documents) * share / F.col("n")).alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("int")
    return rated.withColumn("parts", parts).withColumn("sums", poisson_sums(F.col("rate") / F.col("parts")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict | None = None,
    size: float = 1.0,
    other: float = 0.0,
    seed: str = SEED,
) -> DataFrame:
    """All columns of docs, copy (from 0) and shuffle_key, in shuffled order.

    Without weights every source gets the same. The rates are one row of about a kilobyte per
    source; where they or the repeated ids are too many to be broadcast by Spark's threshold, both
    sides are shuffled and adaptive execution splits a hot key.
    """
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    flat = docs.toDF(*names.values())
    key = F.coalesce(F.concat(F.lit("s"), F.col(names[source_col]).cast("string")), F.lit(""))
    per_source = c.write_rows(rates(flat, names[source_col], weights, size, other), "rates")
    rated = join_unique(identified(flat, names[id_col]).withColumn("source_key", key), per_source, ["source_key"], "inner")
    ident = F.col("ident")
    count = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda j: poisson(F.col("sums"), uniform(F.lit(seed), ident, j.cast("string"))),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    copies = rated.withColumn("copies_", count).filter("copies_ > 0")
    pieces = copies.withColumn("piece_", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies_") - 1) / PIECE).cast("int"))))
    end = F.least((F.col("piece_") + 1) * PIECE, F.col("copies_")) - 1
    rows = pieces.withColumn("copy_", F.explode(F.sequence(F.col("piece_") * PIECE, end)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("copy_").cast("string")).cast("binary"))
    dealt = rows.withColumn("order_", order).repartition("order_").sortWithinPartitions("order_")
    own = [F.col(v).alias(k) for k, v in names.items() if k not in ("copy", "shuffle_key")]
    return dealt.select(*own, F.col("copy_").alias("copy"), F.col("order_").alias("shuffle_key"))


def identified(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds ident, which no two rows share: the id, with a number where several rows have it or it is null."""
    named = rows.withColumn("id_key", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("")))
    again = named.groupBy("id_key").agg(F.count("*").alias("n")).filter("n > 1 OR id_key = ''")
    again = c.write_rows(again.select("id_key"), "shared-ids")
    once = join_unique(named, again, ["id_key"], "left_anti")
    several = join_unique(named, again, ["id_key"], "left_semi")
    ordered = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    several = numbered(several, ["id_key"], ordered)
    ident = F.substring("id_key", 2, 1 << 30)
    with_number = several.withColumn("ident", F.concat_ws("#", "id_key", F.col("numero").cast("string")))
    return once.withColumn("ident", ident).select(*rows.columns, "ident").unionByName(with_number.select(*rows.columns, "ident"))
