"""Answers to stored rows, and the tables the operators fill, written and read back."""

import json

from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.operators import ids, intake, lifecycle, processing
from spinecat.sources import files

def now():
    return F.lit("2024-03-01 12:00:00").cast("timestamp")


def answer(*titles):
    books = [
        {"titulo_detectado": t, "autor_detectado": "Ana Paz", "titulo_corregido": t, "autor_corregido": "Ana Paz", "confianza": 0.9}
        for t in titles
    ]
    return json.dumps({"libros": books})


def world(spark):
    batches = spark.createDataFrame(
        [(1, 7, "procesando", 3), (2, 7, "procesando", 1), (3, 7, "publicado", 1)],
        "id long, libreria_id long, estado string, cant_fotos long",
    )
    photos = spark.createDataFrame(
        [(10, 1, 0), (11, 1, 1), (12, 1, 2), (20, 2, 0), (30, 3, 0)], "id long, lote_id long, orden int"
    )
    odd = json.dumps({"libros": [{"titulo_detectado": "Raro", "confianza": "mucha"}]})
    responses = spark.createDataFrame(
        [(10, answer("Uno", "Dos")), (11, answer("uno", "Viejo")), (12, "{roto"), (20, odd), (30, answer("Tres"))],
        "foto_id long, texto string",
    )
    books = spark.createDataFrame(
        [(5, 7, 3, "Viejo", "Ana Paz", "publicado", None)],
        "id long, libreria_id long, lote_id long, titulo string, autor string, estado string, archivado_en timestamp",
    )
    return responses, photos, batches, books


def test_process_batches(spark, tmp_path):
    new, batches, counters, failed = processing.process_batches(*world(spark), now())
    got = sorted((r.id, r.titulo, r.estado, r.duplicado_de) for r in new.collect())
    assert got == [
        (6, "Uno", "pendiente", None),
        (7, "Dos", "pendiente", None),
        (8, "Viejo", "descartado", 5),
    ]
    assert {r.id: r.estado for r in batches.collect()} == {1: "revision", 2: "revision", 3: "publicado"}
    assert {r.lote_id: (r.nuevos, r.duplicados) for r in counters.collect()} == {1: (2, 1), 2: (0, 0)}
    assert {r.foto_id: r.motivo for r in failed.collect()} == {12: "json", 20: "confianza"}
    files.write_table(new, str(tmp_path), "libros")
    back = files.read_table(spark, str(tmp_path), "libros")
    assert back.schema.names == schemas.LIBROS.names
    assert back.filter("creado_en = timestamp'2024-03-01 12:00:00'").count() == 3


def test_missing_answers_are_listed(spark):
    responses, photos, batches, books = world(spark)
    _, closed, _, failed = processing.process_batches(responses.limit(0), photos, batches, books, now())
    assert {r.motivo for r in failed.collect()} == {"sin_respuesta"}
    assert closed.filter("estado = 'revision'").count() == 2


def test_operator_rows_can_be_stored(spark, tmp_path):
    root = str(tmp_path)
    shops, _ = intake.register_shops(
        spark.createDataFrame([], "slug string"),
        spark.createDataFrame([(1, "Uno", "5491122334455", "", "")], "solicitud long, nombre string, whatsapp string, slug string, mensaje_wa_template string"),
        now(),
    )
    files.write_table(shops, root, "librerias")
    stored = files.read_table(spark, root, "librerias")
    raw = spark.createDataFrame([("uno", "vista", "{}", "s")] * 3, schemas.EVENTOS_RAW)
    events, _ = intake.ingest(raw, stored, now())
    files.write_table(events, root, "eventos")
    uploads = spark.createDataFrame([(1, 7, 1, "a"), (1, 7, 2, "b")], "lote_id long, libreria_id long, subida long, path string")
    batches, photos, _ = intake.make_batches(uploads, now())
    files.write_table(batches, root, "lotes")
    files.write_table(photos, root, "fotos")
    _, _, published = lifecycle.publish(
        files.read_table(spark, root, "lotes").select("id").limit(0).selectExpr(
            "id", "id as lote_id", "'x' as estado", "current_timestamp() as publicado_en"
        ),
        files.read_table(spark, root, "lotes"),
        files.read_table(spark, root, "lotes").select("id"),
        now(),
    )
    files.write_table(published, root, "eventos")
    for name, n in (("librerias", 1), ("eventos", 4), ("lotes", 1), ("fotos", 2)):
        rows = files.read_table(spark, root, name)
        assert rows.count() == n
        assert rows.select("id").distinct().count() == n
        assert rows.filter("id is null or creado_en is null").count() == 0


def test_ids_are_dense_and_references_follow(spark):
    rows = spark.createDataFrame([(108, None), (103, 5), (120, 108), (150, 103)], "id long, duplicado_de long")
    got = sorted(tuple(r) for r in ids.renumber(rows, 100, references=["duplicado_de"]).collect())
    assert got == [(101, 5), (102, None), (103, 102), (104, 101)]
    many = ids.allocate(spark.range(5000, numPartitions=7).selectExpr("id AS a"), ["a"], 41)
    assert {r["a"]: r["id"] for r in many.collect()} == {k: 42 + k for k in range(5000)}
    assert ids.allocate(spark.range(0).selectExpr("id AS a"), ["a"], 3).collect() == []


def test_written_ids_continue(spark, tmp_path):
    """Ids follow the stored ones; the same rows above the same mark get the same ids."""
    root = str(tmp_path)
    photos = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "lote_id long, orden int, path string")
    files.write_table(photos.withColumn("id", F.lit(7).cast("long")).limit(1), root, "fotos")
    files.write_table(photos, root, "fotos")
    rows = {r.path: r.id for r in files.read_table(spark, root, "fotos").filter("id > 7").collect()}
    assert rows == {"a": 8, "b": 9, "c": 10}
    files.write_table(photos, root, "fotos", mode="overwrite")
    assert {r.path: r.id for r in files.read_table(spark, root, "fotos").collect()} == {"a": 1, "b": 2, "c": 3}


def test_two_answers_to_one_photo(spark):
    responses, photos, batches, books = world(spark)
    twice = responses.unionByName(spark.createDataFrame([(10, answer("Aaa"))], responses.schema))
    new, _, _, failed = processing.process_batches(twice, photos, batches, books, now())
    kept = [r for r in new.collect() if r.foto_id == 10]
    assert len({r.id for r in kept}) == len(kept) > 0
    assert (10, "repetida") in {(r.foto_id, r.motivo) for r in failed.collect()}


def test_state_and_failures_need_no_matching(spark, monkeypatch):
    """Each table is computed when it is asked for; these two need no dedup and no ids."""

    def never(*args, **kwargs):
        raise AssertionError("matched")

    monkeypatch.setattr(processing.dedup, "dedup_batches", never)
    monkeypatch.setattr(processing.dedup, "decide_batches", never)
    monkeypatch.setattr(processing.ids, "allocate", never)
    processed = processing.process_batches(*world(spark), now())
    assert processed.batches.filter("estado = 'procesando'").count() == 0
    assert processed.failed.count() > 0


def test_counters_alone_are_those_of_the_rows(spark):
    alone = processing.process_batches(*world(spark), now()).counters.collect()
    _, _, counters, _ = processing.process_batches(*world(spark), now())
    assert sorted(alone) == sorted(counters.collect())


def test_answers_are_parsed_once(spark):
    """Photos with an odd confidence are left out where they are parsed, before the rows are dealt into ranges."""

    def book(title, level):
        return {"titulo_detectado": title, "autor_detectado": "Ana Paz", "autor_corregido": "Ana Paz", "confianza": level}

    responses, photos, batches, books = world(spark)
    told = [
        (10, [book("Uno", 0.5), book("Dos", "mucha")]),
        (11, [book(" ", "mucha"), book("Tres", 0.5)]),
        (12, []),
        (20, [book("Cuatro", 0.5), 7]),
    ]
    answers = spark.createDataFrame([(k, json.dumps({"libros": b})) for k, b in told], responses.schema)
    processed = processing.process_batches(answers, photos, batches, books, now())
    assert [(r.id, r.titulo) for r in processed.books.orderBy("id").collect()] == [(6, "Tres"), (7, "Cuatro")]
    assert [(r.foto_id, r.motivo) for r in processed.failed.collect()] == [(10, "confianza")]
    plan = processed._read()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.replace("_", "").count("parsejson") == 1
    readings = processed._readings._jdf.queryExecution().optimizedPlan().toString().lower()
    assert readings.replace("_", "").count("parsejson") == 0
