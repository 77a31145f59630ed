"""Quality rules by host: rule failures are pooled per host and shrunk with a beta prior.

A document fails the base rules on its own text. The failure rate of its host is shrunk towards
the corpus: with the hosts' rates of mean m and variance v (moments over hosts, weighted by
documents, the sampling part of the variance taken out), the prior is Beta(m*s, (1-m)*s) with
s = m(1-m)/v - 1, and a host's rate is (failed + m*s) / (documents + s). A host whose shrunk rate
is above ``host_limit`` loses all its documents.

Null and empty texts have no words and fail. A null host is a host of its own. Repeated ids are
judged row by row. An empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c

SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _duplicate_lines(text: bytes) -> int:
    seen, count = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.split():
            seen.add(line)
    return count


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = c.word_spans(data, offsets, c.SPACES)
    points = c.code_points(data)
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    hashes = c.word_hashes(data, starts, ends)
    firsts, windows = c.window_hashes(hashes, rows, WINDOW)
    # The row is mixed in, so equal windows of two texts stay apart.
    keys = c.mix(windows + c.ODD * rows[firsts].astype(np.uint64))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = c.cover(firsts[times[back] > 1], WINDOW, len(starts))
    raw = data.tobytes()
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": c.per_row(points[ends] - points[starts], rows, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array([_duplicate_lines(raw[offsets[i] : offsets[i + 1]]) for i in range(n)], dtype=np.int64),
        "n_repeat_words": c.per_row(repeated, rows, n),
    }


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Columns id_, host_ and the base counts of every text."""
    picked = docs.select(
        F.col(id_col).alias("id_"), F.col(host_col).cast("string").alias("host_"), F.col(text_col).alias("text_")
    )
    id_type = picked.schema["id_"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for part, data, offsets in c.slices(batch, "text_"):
                counts = _counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(counts[k]) for k in COUNTS)], ["id_", "host_", *COUNTS]
                )

    return picked.mapInArrow(scan, f"id_ {id_type}, host_ string, " + ", ".join(f"{k} long" for k in COUNTS))


def _prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior, from sums over all hosts (one row reaches the driver)."""
    n, groups, failed, squares = hosts.agg(
        F.sum("docs"), F.count("*"), F.sum("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("docs"))
    ).first()
    if not n:
        return 0.0, 1.0
    mean = failed / n
    binomial = mean * (1 - mean)
    spread = max(squares / n - mean * mean - binomial * groups / n, binomial / 10000, 1e-9)
    return mean, max(binomial / spread - 1, 1.0)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    host_limit: float = 0.5,
) -> DataFrame:
    """One row per document: id_col, host, the counts, base_failed, host_rate, kept.

    The counts are aggregated per host before any shuffle; the join back is on the host, both of
    its sides shuffled or the small one broadcast as Spark's size threshold decides, so adaptive
    execution can split a host with a third of all rows.
    """
    counted = text_counts(docs, id_col, text_col, host_col).withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    counted = c.write_rows(counted, "host-counts")
    host = F.coalesce(F.concat(F.lit("h"), F.col("host_")), F.lit(""))
    hosts = counted.groupBy(host.alias("host_key")).agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    mean, strength = _prior(hosts)
    rates = hosts.select("host_key", ((F.col("failed") + mean * strength) / (F.col("docs") + strength)).alias("host_rate"))
    joined = counted.withColumn("host_key", host).join(rates, "host_key")
    return joined.select(
        F.col("id_").alias(id_col),
        F.col("host_").alias("host"),
        *COUNTS,
        "base_failed",
        "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"),
    )
