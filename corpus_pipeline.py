"""A training corpus in five stages: language, near copies, benchmark passages, personal data, mixing.

Each stage reads what its predecessor wrote and returns documents again; the last one adds the
copy number and the shuffle key. Rows with a null in any column pass through the stages under the
rules of the operators (see their modules); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat.llm import decontaminate, language, mixing, near_copies, pii
from spinecat.llm.common import ready, table, write_rows


#: Most bytes of an Arrow batch. Spark and a Python worker hold some of them at once, and a scan goes
#: over 2 or 3 MB of one at a time, so the 20 MB of 10,000 whole rows only fill an executor's memory.
BATCH_BYTES = "8m"

#: Least score of a text's language: below, no language has a quarter of the text.
LEAST_SCORE = 0.25


def _ready(spark: SparkSession) -> None:
    ready(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _columns(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col("row").getField(x).alias(x) for x in columns])


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of one language, and tells it where the table does not.

    Texts that are null, without a letter, or without a language that scores ``LEAST_SCORE`` (its
    share of the letters times its posterior) go. A null lang becomes the predicted one. Where no
    row has a language to learn, texts with a letter pass as they are.
    """
    _ready(spark)
    model = language.train(docs)
    if not model["langs"]:
        return _columns(language.label(docs, language.letters_only()).filter("lang_pred <> 'und'"), docs.columns)
    judged = language.label(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    told = F.coalesce(F.col("row.lang"), F.col("lang_pred").cast(docs.schema["lang"].dataType))
    return judged.select(*[(told if x == "lang" else F.col("row").getField(x)).alias(x) for x in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five-word shingles stays."""
    _ready(spark)
    return near_copies.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; texts that are mostly benchmark go."""
    _ready(spark)
    return _measured(decontaminate.clean(decontaminate.find(docs, table(spark, sf_dir, "benchmark"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    _ready(spark)
    return _measured(pii.redact(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weight for every source, then a global shuffle."""
    _ready(spark)
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("mixing", mixing_sources),
]

#: Similarity components and language models have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_rows(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
