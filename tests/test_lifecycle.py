import datetime as dt

from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.operators import intake, lifecycle
from spinecat.sources import files

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 3, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def books(spark, *rows):
    """(id, shop, batch, state, copy of, confidence) with the other columns filled in."""
    full = [
        (i, s, b, b * 10 if b else None, f"RAW{i}", "r", f"T{i}", "a", c, st, T0, None, None, d, None)
        for i, s, b, st, d, c in rows
    ]
    return spark.createDataFrame(full, schemas.LIBROS)


def batches(spark, *rows):
    return spark.createDataFrame([(i, s, e, 1, T0, None, None) for i, s, e in rows], schemas.LOTES)


def test_edits_apply_like_one_after_the_other(spark):
    b = books(spark, (1, 1, 1, "pendiente", None, 0.9), (2, 1, 1, "pendiente", None, 0.9))
    edits = spark.createDataFrame(
        [
            (1, " X ", " y ", "publicado", day(1)),
            (1, "Z", None, "vendido", day(2)),
            (1, "Z", "", "pendiente", day(3)),
            (1, "mal", "", "perdido", day(4)),
        ],
        schemas.EDITS,
    )
    out, rejected = lifecycle.apply_edits(b, edits)
    rows = {r.id: r for r in out.collect()}
    assert out.columns == b.columns
    one = rows[1]
    assert (one.titulo, one.autor, one.estado, one.publicado_en, one.vendido_en) == ("Z", "", "pendiente", day(1), day(2))
    assert one.titulo_raw == "RAW1" and rows[2].titulo == "T2"
    assert [(r.libro_id, r.motivo) for r in rejected.collect()] == [(1, "estado")]


def test_review_then_publish(spark):
    b = books(
        spark,
        (1, 1, 1, "pendiente", None, 0.7), (2, 1, 1, "pendiente", None, 0.69),
        (3, 1, 1, "descartado", 1, 0.9), (4, 1, 2, "pendiente", None, 0.9), (5, 1, None, "pendiente", None, 0.9),
    )
    decisions = spark.createDataFrame([(1, "publicar"), (2, "descartar")], "lote_id long, accion string")
    edits = lifecycle.review_edits(b, decisions, now())
    assert {r.libro_id: r.estado for r in edits.collect()} == {1: "publicado", 2: "descartado", 4: "descartado"}
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    l = batches(spark, (1, 1, "revision"), (2, 1, "revision"))
    nb, nl, ev = lifecycle.publish(b, l, ids, now())
    assert {r.id: r.estado for r in nb.collect()} == {1: "publicado", 2: "publicado", 3: "descartado", 4: "pendiente", 5: "pendiente"}
    assert {r.id: (r.estado, r.publicado_en) for r in nl.collect()} == {1: ("publicado", NOW), 2: ("revision", None)}
    assert [(r.libreria_id, r.tipo, r.payload, r.session_id) for r in ev.collect()] == [
        (1, "lote_publicado", '{"lote_id":1,"publicados":2}', None)
    ]
    db, dl = lifecycle.discard(b, l, ids)
    assert {r.id: r.estado for r in db.collect()}[2] == "descartado"
    assert {r.id: r.estado for r in dl.collect()} == {1: "descartado", 2: "revision"}


def test_overrides_in_a_review(spark):
    b = books(spark, (1, 1, 1, "pendiente", None, 0.1), (2, 1, 1, "pendiente", None, 0.9))
    decisions = spark.createDataFrame([(1, "publicar", {1: True, 2: False})], "lote_id long, accion string, aprobados map<bigint,boolean>")
    got = {r.libro_id: r.estado for r in lifecycle.review_edits(b, decisions).collect()}
    assert got == {1: "publicado", 2: "descartado"}


def test_reset_and_deletes(spark):
    b = books(
        spark,
        (1, 1, 1, "publicado", None, 0.9), (2, 1, 1, "descartado", 1, 0.9), (3, 2, 2, "publicado", 1, 0.9),
    )
    l = batches(spark, (1, 1, "publicado"), (2, 2, "publicado"))
    ids = spark.createDataFrame([(1,)], "id long")
    nb, nl, ev = lifecycle.reset(b, l, ids, now())
    assert {r.id: r.archivado_en for r in nb.collect()} == {1: NOW, 2: NOW, 3: None}
    assert [r.payload for r in ev.collect()] == ['{"libros_archivados":2}']
    again, _, ev2 = lifecycle.reset(nb, nl, ids, F.current_timestamp())
    assert {r.id: r.archivado_en for r in again.collect()} == {1: NOW, 2: NOW, 3: None}
    assert [r.payload for r in ev2.collect()] == ['{"libros_archivados":0}']
    left = {r.id: r.duplicado_de for r in lifecycle.delete_books(b, ids).collect()}
    assert left == {2: None, 3: None}
    tables = {
        "librerias": spark.createDataFrame([(1,), (2,)], "id long"),
        "lotes": l,
        "fotos": spark.createDataFrame([(10, 1), (20, 2)], "id long, lote_id long"),
        "libros": b,
        "eventos": spark.createDataFrame([(7, 1), (8, 2)], "id long, libreria_id long"),
    }
    gone = lifecycle.delete_shops(tables, ids)
    assert {n: [r.id for r in df.collect()] for n, df in gone.items()} == {
        "librerias": [2], "lotes": [2], "fotos": [20], "libros": [3], "eventos": [8],
    }
    assert gone["libros"].first().duplicado_de is None and gone["libros"].first().lote_id == 2


def test_sold_restore_close(spark):
    b = books(spark, (1, 1, 1, "publicado", None, 0.9))
    ids = spark.createDataFrame([(1,)], "id long")
    sold, _ = lifecycle.apply_edits(b, lifecycle.mark_sold(b, ids, now()))
    assert (sold.first().estado, sold.first().vendido_en) == ("vendido", NOW)
    back, _ = lifecycle.apply_edits(b, lifecycle.restore_raw(b, ids, now()))
    assert (back.first().titulo, back.first().autor) == ("RAW1", "r")
    done = lifecycle.close_processing(batches(spark, (1, 1, "procesando")), ids)
    assert done.first().estado == "revision"


def test_batches_and_registration(spark):
    uploads = [(1, 1, i, f"{i}.jpg") for i in (3, 1, 2)] + [(2, 1, i, "x") for i in range(11)]
    files_in = spark.createDataFrame(uploads, "lote_id long, libreria_id long, subida long, path string")
    new, photos, rejected = intake.make_batches(files_in)
    assert [(r.id, r.estado, r.cant_fotos) for r in new.collect()] == [(1, "procesando", 3)]
    assert sorted((r.orden, r.path) for r in photos.collect()) == [(0, "1.jpg"), (1, "2.jpg"), (2, "3.jpg")]
    assert [(r.lote_id, r.motivo) for r in rejected.collect()] == [(2, "cantidad")]
    existing = spark.createDataFrame([("ya",)], "slug string")
    asked = spark.createDataFrame(
        [
            (1, " Uno ", " 5491122334455 ", "", " "),
            (2, "UNO", "5491122334455", "", "x"),
            (3, "Ya", "5491122334455", "", "x"),
            (4, "Dos", "123", "uno", "x"),
            (5, "Tres", "5491122334455", "  ", "x"),
        ],
        "solicitud long, nombre string, whatsapp string, slug string, mensaje_wa_template string",
    )
    good, bad = intake.register_shops(existing, asked)
    assert sorted((r.solicitud, r.slug, r.nombre) for r in good.collect()) == [(1, "uno", "Uno"), (5, "libreria", "Tres")]
    assert good.filter("solicitud = 1").first().mensaje_wa_template == schemas.DEFAULT_TEMPLATE
    assert {r.solicitud: r.motivo for r in bad.collect()} == {2: "slug", 3: "slug", 4: "whatsapp"}


def test_tables_round_trip(spark, tmp_path):
    b = books(spark, (1, 1, 1, "publicado", None, 0.9))
    files.write_table(b, str(tmp_path), "libros")
    again = files.read_table(spark, str(tmp_path), "libros")
    assert again.schema == schemas.LIBROS and again.collect() == b.collect()
