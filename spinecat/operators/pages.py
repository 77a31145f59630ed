"""Ordered JSON documents of bounded size, and positions in ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat.session import materialise


def json_pages(
    df: DataFrame, keys: list[str], order: list[str], record: Column, page_size: int
) -> DataFrame:
    """Rows of each key as JSON arrays of at most ``page_size`` records, in order.

    ``pagina`` counts from 0, ``paginas`` is the number of pages of the key. The rows of a key that
    fills more than a page are numbered over range partitions, so no task ever holds a whole key, and a
    page is bounded by its size; the others go to their one page as they are.
    """
    entry = F.struct(*order, F.struct(record.alias("registro")).alias("r"))
    rows = materialise(df.select(*keys, *[x for x in order if x not in keys], entry.alias("entrada")))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("m")).filter(F.col("m") > page_size)
    # One row for each full page of the input at most.
    large = totals.select(*[F.col(k).alias(f"{k}_largo") for k in keys], F.ceil(F.col("m") / page_size).cast("long").alias("paginas"))
    large = materialise(large)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_largo")) for k in keys]
    counted = numbered(rows.join(F.broadcast(large), same, "left_semi"), keys, order)
    placed = counted.select(*keys, F.floor((F.col("numero") - 1) / page_size).cast("long").alias("pagina"), "entrada")
    first = rows.join(F.broadcast(large), same, "left_anti").select(*keys, F.lit(0).cast("long").alias("pagina"), "entrada")
    pages = first.unionByName(placed).groupBy(*keys, "pagina").agg(F.sort_array(F.collect_list("entrada")).alias("e"))
    documents = pages.select(
        *keys,
        "pagina",
        F.size("e").cast("long").alias("n"),
        F.to_json(F.col("e.r.registro")).alias("documento"),
    )
    joined = documents.join(F.broadcast(large), same, "left")
    # Written, so that the rows and their shuffle are gone before the documents are shuffled.
    return materialise(joined.select(*documents.columns, F.coalesce("paginas", F.lit(1).cast("long")).alias("paginas")), replaces=rows)


def ranged(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows dealt into ranges of (keys, order); ``tramo`` is the number of the range.

    Writing fixes the ranges, so that a lost executor cannot move a row between two
    passes over them.
    """
    spread = rows.repartitionByRange(*keys, *order).withColumn("tramo", F.spark_partition_id())
    return materialise(spread)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Position ``numero`` of each row within its key, without a task that sees the whole key."""
    fixed = ranged(rows, keys, order)
    counts = fixed.groupBy(*keys, "tramo").agg(F.count("*").alias("m"))
    local = Window.partitionBy(*keys, "tramo").orderBy(*order)
    here = fixed.withColumn("local", F.row_number().over(local))
    return carried(here, counts, keys).select(*rows.columns, (F.col("local") + F.col("previos")).alias("numero"))


def carried(here: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``previos``, what earlier ranges hold of a row's key, from the totals ``m`` of each range.

    A boundary of two ranges cuts at most one key, so fewer of these sums than ranges are not 0, and
    they reach the rows without a shuffle of these.
    """
    before = Window.partitionBy(*keys).orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.withColumn("previos", F.sum("m").over(before)).filter("previos <> 0")
    names = [*keys, "tramo"]
    sums = sums.select(*[F.col(k).alias(f"{k}_cortado") for k in names], "previos")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_cortado")) for k in names]
    joined = here.join(F.broadcast(sums), same, "left")
    return joined.select(*here.columns, F.coalesce("previos", F.lit(0)).alias("previos"))
