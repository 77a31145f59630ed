"""Joins against tables with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXTRA = "_reparto"


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join rows to a grouped table so that a key with a third of all rows can be split.

    A table that comes out of ``groupBy(keys)`` is already partitioned by the join keys, so
    Spark would join it in place, and adaptive execution can only split hot partitions of
    joins that shuffle both sides. One more join column, always zero, makes it shuffle both.
    A right side below the broadcast threshold is still broadcast. Semi and anti joins work alike.
    """
    zero = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))
    joined = left.withColumn(_EXTRA, zero).join(
        right.withColumn(_EXTRA, zero), [*keys, _EXTRA], how
    )
    return joined.drop(_EXTRA)
