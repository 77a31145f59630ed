"""Plans and results when one key holds most of the rows."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from spinecat.operators import cohorts, lifecycle, metrics, pages, quality, search
from spinecat.plans import adapters as A
from spinecat.session import configure


@pytest.fixture
def eager_skew(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_huge_group_of_copies_is_split(eager_skew, tmp_path):
    path = str(tmp_path / "d")
    eager_skew.range(0, 40_000, 1, 8).select(
        F.col("id").alias("doc"),
        F.when(F.col("id") % 3 != 0, F.lit("copia")).otherwise(F.md5(F.col("id").cast("string"))).alias("h"),
    ).write.parquet(path)
    marked = quality.mark_copies(eager_skew.read.parquet(path), "doc", "h")
    rows = marked.agg(F.count("duplicado_exacto_de").alias("n"), F.count("*").alias("t")).first()
    kept = marked.filter("duplicado_exacto_de is not null").select("duplicado_exacto_de").distinct()
    assert [r[0] for r in kept.collect()] == [1]
    assert (rows.n, rows.t) == (26_665, 40_000)
    marked.collect()
    assert "skew=true" in plan(marked)


def test_top_lists_cut_before_the_shuffle(spark):
    events = A.eventos(spark, "/root/testdata/sf0.001")
    for df in (metrics.recent_events(events), metrics.top_zero_result_terms(events)):
        assert plan(df).count("WindowGroupLimit") == 2


def test_one_hot_term_and_title(spark):
    books = spark.range(0, 5_000).select(
        "id", F.lit(1).cast("long").alias("libreria_id"), F.lit("El mismo libro").alias("titulo"), F.lit("").alias("autor")
    )
    queries = spark.range(0, 5_000).select(
        F.col("id").alias("consulta_id"), F.lit(1).cast("long").alias("libreria_id"), F.lit("mismo").alias("q")
    )
    row = search.result_counts(queries, books).agg(F.sum("resultados").alias("s"), F.count("*").alias("n")).first()
    assert (row.s, row.n) == (25_000_000, 5_000)


def test_catalogue_filter_reaches_the_scan(spark):
    lines = A.table(spark, "/root/testdata/sf0.001", "lineitem")
    text = plan(lines.filter(F.col("l_returnflag") == "R").select("l_orderkey"))
    assert "EqualTo(l_returnflag,R)" in text and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text


def test_a_hot_shop_is_split_when_shops_are_deleted(eager_skew, tmp_path):
    """Two thirds of the events belong to one shop; a third of all goes with the deleted ones."""
    path = str(tmp_path / "e")
    eager_skew.range(0, 40_000, 1, 8).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.lit(-1)).otherwise(F.col("id") % 50).cast("long").alias("libreria_id"),
        F.md5(F.col("id").cast("string")).alias("payload"),
    ).write.parquet(path)
    events = eager_skew.read.parquet(path)
    none = eager_skew.createDataFrame([], "id long, libreria_id long, lote_id long, foto_id long, duplicado_de long")
    tables = {
        "librerias": eager_skew.range(-1, 50),
        "lotes": none.select("id", "libreria_id"),
        "fotos": none.select("id", "lote_id"),
        "libros": none,
        "eventos": events,
    }
    left = lifecycle.delete_shops(tables, eager_skew.range(0, 50))["eventos"]
    assert {r[0] for r in left.select("libreria_id").distinct().collect()} == {-1}
    assert len(left.collect()) == 26_666
    assert "skew=true" in plan(left)


def test_a_hot_shop_is_numbered_by_many_tasks(eager_skew):
    rows = eager_skew.range(0, 20_000, 1, 8).select(
        "id", F.lit("s").alias("slug"), F.md5(F.col("id").cast("string")).alias("titulo")
    )
    fixed = pages.ranged(rows, ["slug"], ["titulo", "id"])
    assert fixed.groupBy("tramo").count().filter("count > 10000").count() == 0
    got = pages.numbered(rows, ["slug"], ["titulo", "id"]).orderBy("titulo", "id").collect()
    assert [r.numero for r in got] == list(range(1, 20_001))


def test_an_import_of_one_day_is_spread_over_ranges(spark):
    """All batches of a shop on one day; each one's gap is to the next."""
    batches = spark.range(0, 10_000, 1, 8).select(
        "id",
        F.lit(1).cast("long").alias("libreria_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3).alias("creado_en"),
    )
    gaps = {r.id: r.horas_al_siguiente for r in cohorts.batch_gaps(batches).collect()}
    assert gaps.pop(9_999) is None
    assert len(gaps) == 9_999 and set(gaps.values()) == {3 / 3600}


def test_narrow_rows_are_not_merged_into_a_few_tasks(spark):
    """Line numbers alone shrink to some bytes each: a task still gets a bounded number of rows."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            configure(spark).conf.set(k, v)
        rows = spark.range(0, 6_000_000, 1, 4).select((F.col("id") / 4).cast("long").alias("lote_id")).repartition("lote_id")
        most = rows.groupBy(F.spark_partition_id().alias("tarea")).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most < 2_000_000
