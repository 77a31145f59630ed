"""A stream fed file by file must end with the rows of the batch operator."""

import datetime as dt
import random

import plain
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_dedup import AUTHORS, READING, TITLES

from spinecat import schemas
from spinecat.operators import cohorts, intake
from spinecat.sources import files
from spinecat.streaming import index, jobs

T0 = dt.datetime(2024, 1, 3)


def write_parts(df_of, parts, folder):
    """One file per part, in order of arrival."""
    for rows in parts:
        df_of(rows).coalesce(1).write.mode("append").parquet(folder)


def events(n=240):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        tipo = rnd.choice(["vista", "busqueda", "clic_whatsapp", "lote_publicado"])
        payload = {"busqueda": '{"q":"x","resultados":0}', "lote_publicado": '{"publicados":3}'}.get(tipo, "{}")
        rows.append((i, rnd.randrange(3), tipo, payload, rnd.choice(["s1", "s2", "", None]), T0 + dt.timedelta(hours=i)))
    return rows


def test_weekly_counts_equal_the_batch(spark, tmp_path):
    rows = events()
    folder = str(tmp_path / "in")
    make = lambda r: spark.createDataFrame(r, schemas.EVENTOS)
    write_parts(make, [rows[i : i + 60] for i in range(0, len(rows), 60)], folder)
    stream = spark.readStream.schema(schemas.EVENTOS).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = jobs.weekly_counts(stream)
    out = str(tmp_path / "out")
    jobs.start_table(counts, out).awaitTermination()
    parts = jobs.read_parts(spark, out + "/datos", counts.schema)
    assert parts.select("epoca").distinct().count() > 1
    got = jobs.newest(parts, ["libreria_id", "semana"])
    expected = cohorts.weekly_activity(make(rows))
    cols = sorted(expected.columns)
    assert sorted(got.select(cols).collect()) == sorted(expected.select(cols).collect())


def test_ingest_twice_from_the_same_checkpoint_adds_nothing(spark, tmp_path):
    shops = spark.createDataFrame([("uno", 1, True), ("dos", 2, False)], "slug string, id long, activa boolean")
    raw = [("uno", "vista", "{}", ""), ("uno", "lote_publicado", "{}", "s"), ("dos", "vista", "{}", "s"), ("tres", "vista", None, "s"), ("uno", "scan_qr", None, "s")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(raw, schemas.EVENTOS_RAW).coalesce(1).write.parquet(folder)
    for _ in range(2):
        stream = spark.readStream.schema(schemas.EVENTOS_RAW).parquet(folder)
        jobs.start_ingest(stream, shops, out).awaitTermination()
    good = spark.read.parquet(out + "/aceptados").collect()
    assert len(good) == 2
    assert {(r.libreria_id, r.tipo, r.payload, r.session_id) for r in good} == {
        (1, "scan_qr", "{}", "s"), (1, "vista", "{}", None),
    }
    bad = spark.read.parquet(out + "/rechazados")
    assert sorted(r.motivo for r in bad.collect()) == ["slug", "slug", "tipo"]
    accepted, refused = intake.ingest(spark.createDataFrame(raw, schemas.EVENTOS_RAW), shops)
    assert accepted.count() == 2 and refused.count() == 3


def test_progress_equals_the_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.randrange(5), rnd.randrange(8), rnd.choice([None, 7])) for _ in range(120)]
    schema = "lote_id long, foto_id long, duplicado_de long"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda r: spark.createDataFrame(r, schema)
    write_parts(make, [rows[:50], rows[50:90], rows[90:]], folder)
    stream = spark.readStream.schema(make([]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    progress = jobs.batch_progress(stream)
    jobs.start_table(progress, out).awaitTermination()
    got = jobs.newest(jobs.read_parts(spark, out + "/datos", progress.schema), ["lote_id"])
    expected = jobs.batch_progress(make(rows))
    assert sorted(got.collect()) == sorted(expected.select(got.columns).collect())


def test_sessions_close_after_the_gap(spark, tmp_path):
    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)

    rows = [
        (1, 1, "vista", "{}", "s", at(0)), (2, 1, "busqueda", "{}", "s", at(10)),
        (3, 1, "vista", "{}", "s", at(60)), (4, 1, "vista", "{}", "", at(61)),
        (5, 1, "vista", "{}", "fin", at(1000)),
    ]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schemas.EVENTOS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schemas.EVENTOS).parquet(folder)
    closed = jobs.session_activity(stream)
    jobs.start_table(closed, out, mode="append").awaitTermination()
    got = jobs.read_parts(spark, out + "/datos", closed.schema).collect()
    assert sorted((r.session_id, r.inicio, r.cierre, r.eventos, r.busquedas) for r in got) == [
        ("s", at(0), at(40), 2, 1), ("s", at(60), at(90), 1, 0),
    ]


def test_late_events_are_in_one_stretch(spark):
    """Late events inside a closed stretch, between two of them, and after one."""

    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)

    stored = [("s", 0), ("s", 5), ("s", 10), ("b", 0), ("b", 25), ("b", 50), ("d", 0), ("d", 35), ("ok", 0), ("ok", 1), ("new", 3)]
    closed = [("s", 0, 10, 2), ("b", 0, 0, 1), ("b", 50, 50, 1), ("d", 0, 0, 1), ("ok", 0, 1, 2)]
    events_ = spark.createDataFrame([(i, 1, "clic_whatsapp", "{}", s, at(m)) for i, (s, m) in enumerate(stored)], schemas.EVENTOS)
    rows = spark.createDataFrame(
        [(1, s, at(a), at(b + 30), n, 0, n) for s, a, b, n in closed],
        "libreria_id long, session_id string, inicio timestamp, cierre timestamp, eventos long, busquedas long, clics long",
    )
    got = sorted((r.session_id, r.inicio, r.cierre, r.eventos, r.clics, r.cerrada) for r in jobs.all_sessions(rows, events_).collect())
    assert got == [
        ("b", at(0), at(80), 3, 3, False),
        ("d", at(0), at(30), 1, 1, True), ("d", at(35), at(65), 1, 1, False),
        ("new", at(3), at(33), 1, 1, False), ("ok", at(0), at(31), 2, 2, True),
        ("s", at(0), at(40), 3, 3, False),
    ]


def test_dedup_in_parts_equals_the_sequential_rule(spark, tmp_path):
    """Batches cut in the middle: what the first part kept still counts for the second."""
    rnd = random.Random(12)
    readings = [
        {
            "id": 10_000 - i, "shop": 1, "batch": i // 12, "orden": (i % 12) // 4,
            "title": rnd.choice(TITLES), "author": rnd.choice(AUTHORS), "read": "t",
        }
        for i in range(96)
    ]
    readings.sort(key=lambda r: (r["batch"], r["orden"], r["id"]))
    make = lambda rs: spark.createDataFrame(
        [(r["id"], 1, r["batch"], 1, r["orden"], "t", "", r["title"], r["author"], 0.5) for r in rs],
        READING,
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(make, [readings[:28], readings[28:56], readings[56:]], folder)
    stream = spark.readStream.schema(make([]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.start_dedup(stream, out).awaitTermination()
    rows = jobs.stored_books(spark, out).collect()
    assert sorted((r.id, r.lote_id, r.duplicado_de) for r in rows) == sorted(
        plain.sequential_dedup(readings, [])
    )


def test_closed_books_leave_the_index(spark, tmp_path):
    make = lambda i, b: spark.createDataFrame(
        [(i, 1, b, 1, 0, "t", "", "Rayuela", "", 0.5)], READING
    )
    folder, out, gone = (str(tmp_path / x) for x in ("in", "out", "gone"))
    for i in range(1, 4):
        make(i, i).write.mode("append").parquet(folder)
    spark.createDataFrame([(1,)], "id long").write.parquet(gone)
    stream = spark.readStream.schema(make(1, 1).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.start_dedup(stream, out, closed=gone).awaitTermination()
    assert {r.id: r.duplicado_de for r in jobs.stored_books(spark, out).collect()} == {1: None, 2: None, 3: 2}


def test_index_parts_and_buckets(spark, tmp_path):
    """Every micro-batch is in exactly one live part, a retry adds nothing, other buckets are not read."""
    for before in range(70):
        held = sorted(e for level, n in index.live_parts(before, 3) for e in range(n * 3**level, (n + 1) * 3**level))
        assert held == list(range(before))
    schema = spark.createDataFrame([], "k string, n long").schema
    store = index.Index(spark, str(tmp_path / "ix"), schema, ["k"], fan=2)
    make = lambda e: spark.createDataFrame([(f"k{j}", e) for j in range(30)] if e != 3 else [], schema)
    store.start(make(100))
    for epoch in (0, 1, 1, 2, 3, 3, 4):
        store.add(make(epoch), epoch)
    got = store.asked(spark.createDataFrame([("k7",)], "k string"), 5)
    assert sorted(r.n for r in got.filter("k = 'k7'").collect()) == [0, 1, 2, 4, 100]
    assert sorted(r.n for r in store.asked(make(0), 2).filter("k = 'k7'").collect()) == [0, 1, 100]
    buckets = {f.split("cubo=")[1].split("/")[0] for f in got.inputFiles() if "cubo=" in f}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cubo" in plan
    assert len(spark.createDataFrame([(f"k{j}",) for j in range(30)], "k string").select(index.bucket("k")).distinct().collect()) > 5
    assert len(buckets) >= 1 and len({r.k for r in got.collect()}) < 10


def test_dedup_starts_from_a_stored_catalogue(spark, tmp_path):
    make = lambda i, b, t: spark.createDataFrame(
        [(i, 1, b, 1, 0, "t", "", t, "", 0.5)], READING
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    make(11, 5, "Rayuela").write.mode("append").parquet(folder)
    make(12, 6, "Ficciones").write.mode("append").parquet(folder)
    old = files.stored(
        spark.createDataFrame(
            [(3, 1, 2, "Rayuela", "", "publicado"), (4, 1, 2, "Ficciones", "", "descartado")],
            "id long, libreria_id long, lote_id long, titulo string, autor string, estado string",
        ),
        "libros",
    )
    stream = spark.readStream.schema(make(1, 1, "").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.start_dedup(stream, out, existing=old).awaitTermination()
    assert {r.id: r.duplicado_de for r in jobs.stored_books(spark, out).collect()} == {11: 3, 12: None}


def test_a_crash_between_the_sinks_of_a_micro_batch_shows_neither(spark, tmp_path, monkeypatch):
    shops = spark.createDataFrame([("uno", 1, True)], "slug string, id long, activa boolean")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda r: spark.createDataFrame(r, schemas.EVENTOS_RAW)
    write_parts(make, [[("uno", "vista", "{}", "s"), ("tres", "vista", "{}", "s")]], folder)
    written = jobs._part

    def start():
        stream = spark.readStream.schema(schemas.EVENTOS_RAW).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.start_ingest(stream, shops, out).awaitTermination()

    def count(sink):
        return jobs.committed(spark, out, sink, schemas.EVENTOS_RAW).count()

    def cut(df, path, epoch):
        if path.endswith("rechazados"):
            raise RuntimeError("lost")
        written(df, path, epoch)

    for before in (0, 1):  # in the first micro-batch, and in a later one
        monkeypatch.setattr(jobs, "_part", cut)
        with pytest.raises(StreamingQueryException):
            start()
        assert spark.read.parquet(out + "/aceptados").count() == before + 1
        assert (count("aceptados"), count("rechazados")) == (before, before)
        monkeypatch.setattr(jobs, "_part", written)
        start()
        assert (count("aceptados"), count("rechazados")) == (before + 1, before + 1)
        write_parts(make, [[("uno", "scan_qr", "{}", "s"), ("tres", "vista", "{}", "s")]], folder)


def test_folded_parts_give_the_newest_rows(spark, tmp_path):
    rows = [(i % 4, i, None) for i in range(14)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda r: spark.createDataFrame(r, "lote_id long, foto_id long, duplicado_de long")
    write_parts(make, [rows[i : i + 2] for i in range(0, 14, 2)], folder)
    stream = spark.readStream.schema(make([]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    progress = jobs.batch_progress(stream)
    jobs.start_table(progress, out, keys=["lote_id"], fan=2).awaitTermination()
    got = jobs.current(spark, out, progress.schema, ["lote_id"], fan=2)
    every = jobs.newest(jobs.read_parts(spark, out + "/datos", progress.schema), ["lote_id"])
    expected = jobs.batch_progress(make(rows))
    assert sorted(got.collect()) == sorted(every.collect()) == sorted(expected.collect())
    # Seven micro-batches: four in one fold, two in another, one as it was written.
    read = {x.split("/out/")[1].rsplit("/", 1)[0] for x in got.inputFiles()}
    assert read == {"pliegues/nivel=2/parte=0", "pliegues/nivel=1/parte=2", "datos/epoca=6"}


def test_a_stream_of_readings_leaves_no_shuffle_files(spark, tmp_path):
    readings = spark.range(0, 400).select(
        "id", F.lit(1).cast("long").alias("libreria_id"), (F.col("id") % 50).alias("lote_id"), F.lit(1).cast("long").alias("foto_id"),
        F.lit(0).alias("orden"), F.lit("t").alias("titulo_detectado"), F.lit("").alias("autor_detectado"),
        F.concat(F.lit("Libro "), (F.col("id") % 90).cast("string")).alias("titulo_corregido"), F.lit("").alias("autor_corregido"),
        F.lit(0.5).alias("confianza"),
    )
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    readings.write.parquet(folder)
    stream = spark.readStream.schema(readings.schema).parquet(folder)
    files_of = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files_of()
    jobs.start_dedup(stream, out).awaitTermination()
    assert files_of() <= before
    assert jobs.stored_books(spark, out).filter("duplicado_de is null").count() == 90


def test_a_later_arrival_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from spinecat.plans import registry

    monkeypatch.setattr(registry, "run_dir", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4KB")
    spark.conf.set("spark.sql.files.openCostInBytes", "1KB")
    try:
        registry.QUERIES["stream_dedup_parts"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    parts = tmp_path / "partes"
    assert len(list((parts / "entrada").glob("*.parquet"))) > 3
    assert len(list((parts / "datos").glob("epoca=*"))) == 3
