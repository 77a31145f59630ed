"""Session defaults and the shared scratch location for checkpoints and stream sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Setting under which Spark removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of written results, as long as these are in use.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows of a few keys take about five bytes when shuffled but some hundred when sorted and grouped,
    # so the default of 64 MB would give one task over ten million of them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    # The last duplicate key of a JSON object wins, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spinecat")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a folder
    of the warehouse, which executors share as well. It also becomes the checkpoint folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_spinecat"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder of the shared folder, one per run."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write_rows(df: DataFrame, label: str, replaces: DataFrame | None = None, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    The shuffle files of the step are removed once it is written. ``replaces`` is an earlier result
    of this function that nothing reads any more; its folder is emptied.
    """
    spark = df.sparkSession
    folder = run_dir(spark, label)
    with shuffles_removed(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    if replaces is not None and replaces in _FOLDERS:
        spark.createDataFrame([], replaces.schema).write.mode("overwrite").parquet(_FOLDERS.pop(replaces))
    return out


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Rows of a step, computed once and written in columns; a checkpoint computes its last stage twice."""
    return write_rows(df, "paso", replaces, "zstd")
