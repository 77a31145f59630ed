import json
import random

import plain
from pyspark.sql import functions as F

from spinecat.operators import quality
from spinecat.plans import adapters as A
from spinecat.sources import files, responses

WORDS = ["a", "ab", "la", "casa", "cas", "río", "x", "de", ""]


def title(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 6)))


def build(spark, worlds):
    """worlds: list of (photo, expected [(title, author, visible)], found [(title, author)] or None)."""
    answers, truth = [], {}
    for photo, expected, found in worlds:
        truth[str(photo)] = [
            {"titulo": t, "autor": a, "autor_visible_en_foto": v} for t, a, v in expected
        ]
        books = [
            {
                "titulo_detectado": t or "leido",
                "autor_detectado": "Ana",
                "titulo_corregido": t,
                "autor_corregido": a,
                "confianza": 0.5,
            }
            for t, a in found or []
        ]
        body = json.dumps({"libros": books}) if found is not None else "{roto"
        answers.append(("m", 1, photo, body, 0.25, 100 + photo))
    rs = spark.createDataFrame(
        answers,
        "modelo string, lote_id long, foto_id long, texto string, costo double, latencia_ms long",
    )
    ts = spark.createDataFrame([(json.dumps(truth),)], "texto string")
    return responses.books(responses.read(rs, lenient=True)), files.truth_photos(ts)


def test_greedy_assignment_matches_the_loop(spark):
    rnd = random.Random(11)
    worlds = []
    for photo in range(300):
        expected = [(title(rnd), "", False) for _ in range(rnd.randrange(1, 7))]
        found = [(title(rnd), "") for _ in range(rnd.randrange(0, 7))]
        worlds.append((photo, expected, found))
    books, truth = build(spark, worlds)
    got = {r.foto: r.elegido for r in quality.assigned(books, truth).collect()}
    for photo, expected, found in worlds:
        wanted = plain.assign([e[0] for e in expected], [f[0] or "leido" for f in found])
        assert got[str(photo)] == wanted, (photo, expected, found)
    pairs = {(r.foto, r.pos_esperado, r.pos_detectado) for r in quality.title_match_pairs(books, truth).collect()}
    assert pairs == {
        (str(photo), i, j)
        for photo, expected, found in worlds
        for i, e in enumerate(expected)
        for j, f in enumerate(found)
        if plain.overlaps(plain.key(e[0]), plain.key(f[0] or "leido"))
    }


def test_scores(spark):
    worlds = [
        (1, [("Las olas", "Ángel Gargiulo", True), ("Pesadilla", "", False)], [("Pesadilla", "Juan"), ("las olas", "gargiulo")]),
        (2, [("El príncipe", "Maquiavelo", True)], [("El principe", "")]),
        (3, [("Artificial", "Sigman", True)], None),
        (4, [("Uno", "", False)], []),
    ]
    books, truth = build(spark, worlds)
    row = quality.scores(books, truth).first()
    assert row.asDict() == {
        "modelo": "m", "titulos_ok": 3, "titulos_total": 5, "autores_ok": 1, "autores_total": 2,
        "autores_inventados": 1, "libros_devueltos": 3, "fotos_fallidas": 1, "costo": 0.75,
        "latencia_media": 102,
    }


def test_image_metrics_and_bands(spark):
    books, _ = build(spark, [(1, [], [("a", "b")] * 6), (2, [], []), (3, [], [("a", "")] * 15)])
    rows = {r.foto_id: r for r in quality.image_metrics(books).collect()}
    assert (rows[1].cant_libros, rows[1].confianza_media) == (6, 0.5)
    assert (rows[2].cant_libros, rows[2].confianza_media) == (0, 0.0)
    table = quality.guard_crosstab(quality.image_metrics(books)).collect()
    assert sorted((r.banda, r.fotos, r.alto, r.medio, r.bajo) for r in table) == [
        ("14-19", 1, 0, 0, 1), ("5-13", 1, 0, 0, 1), ("<5", 1, 0, 0, 1),
    ]


def test_bands_count_every_photo_once(spark):
    rows = [(n, d) for n in range(40) for d in range(0, n + 1, 3)]
    df = spark.createDataFrame(rows, "cant_libros int, guardrail_disparado int")
    for bands in (None, [(2, 2), (5, 7)]):
        table = quality.guard_crosstab(df, bands).collect()
        assert sum(r.fotos for r in table) == len(rows)
        assert all(r.alto + r.medio + r.bajo == r.fotos for r in table)


def test_failed_answers_keep_a_row_without_cost(spark):
    books, _ = build(spark, [(1, [], [("a", "b")]), (2, [], None)])
    rows = {r.foto_id: r for r in quality.image_metrics(books).collect()}
    assert (rows[2].ok, rows[2].cant_libros, rows[2].costo, rows[2].latencia_ms) == (False, 0, 0.0, 102)
    assert (rows[1].ok, rows[1].costo) == (True, 0.25)


def test_two_answers_to_one_photo_are_scored_apart(spark):
    one, truth = build(spark, [(1, [("Uno", "", False)], [("Uno", "")])])
    row = quality.scores(one.unionByName(one), truth).first()
    assert (row.titulos_ok, row.titulos_total, row.libros_devueltos, row.costo) == (2, 2, 2, 0.5)
    assert [r.cant_libros for r in quality.image_metrics(one.unionByName(one)).collect()] == [1, 1]


def test_blank_corrected_title_is_no_title(spark):
    books, truth = build(spark, [(1, [("leido", "", False)], [("   ", "")])])
    assert quality.scores(books, truth).first().titulos_ok == 0
    books, truth = build(spark, [(1, [("leido", "", False)], [("", "")])])
    assert quality.scores(books, truth).first().titulos_ok == 1


def test_variants(spark):
    df = spark.createDataFrame(
        [("f.jpg", 25, 0.82), ("f.jpg [bn]", 26, 0.87), ("f.jpg [mas_brillo]", 32, 0.79)],
        "etiqueta string, cant_libros int, confianza_media double",
    )
    rows = sorted((r.foto, r.variante, r.cant_libros) for r in quality.variants(df).collect())
    assert rows == [("f.jpg", "bn", 26), ("f.jpg", "mas_brillo", 32), ("f.jpg", "original", 25)]


def test_copies_keep_the_first_name(spark, tmp_path):
    for name, content in {"b.JPG": b"1", "a b.jpg": b"1", "c.webp": b"2", "n.txt": b"1"}.items():
        (tmp_path / name).write_bytes(content)
    images = files.read_images(spark, str(tmp_path))
    marked = quality.mark_copies(images, "nombre", "huella")
    got = {r.nombre: r.duplicado_exacto_de for r in marked.collect()}
    assert got == {"a b.jpg": None, "b.JPG": "a b.jpg", "c.webp": None}
    copies = marked.filter(F.col("duplicado_exacto_de").isNotNull())
    left = quality.unique_files(images, copies, "nombre")
    assert sorted(r.nombre for r in left.collect()) == ["a b.jpg", "c.webp"]


def test_truth_and_log_files(spark, tmp_path):
    truth = tmp_path / "verdad.json"
    truth.write_text('{"6": [{"titulo": "A", "autor": "", "autor_visible_en_foto": false,\n"nota": "n"}], "7": []}')
    rows = files.read_truth(spark, str(truth)).collect()
    assert [(r.foto, r.pos, r.titulo, r.nota) for r in rows] == [("6", 0, "A", "n")]
    log = tmp_path / "app.log"
    log.write_text(
        "INFO vision_ok intento=2 modelo=x/y latencia_ms=900 tokens={'prompt_tokens': 5, 'cost': 0.01} respuesta='{}'\n"
        "WARNING vision_fallo intento=1 modelo=x/y latencia_ms=100 error=mal\n"
        "INFO lote_procesado lote_id=4 libreria_id=2 nuevos=3 duplicados=1\nnada\n"
    )
    calls = files.read_log(spark, str(log))
    row = quality.call_economics(calls).first()
    assert (row.llamadas, row.reintentos, row.fallos, row.costo, row.latencia_media) == (2, 1, 1, 0.01, 500.0)
    assert quality.batch_costs(calls).first().costo_por_lote == 0.01
    p = quality.latency_percentiles(calls).first()
    assert (p.p50, p.p95) == (100, 900)


def test_keys_are_made_after_the_sides_meet(spark):
    """The join by photo shuffles the books as they were read, not their keys and words."""
    books = "array<struct<pos:int,titulo:string,autor:string,confianza:double,autor_descartado:string>>"
    answers = spark.createDataFrame([("m", 1, [(0, "El Áleph", "Borges", 0.5, None)])], f"modelo string, foto_id long, libros {books}")
    truth = spark.createDataFrame([("1", [("el aleph", "", True, None)])], "foto string, esperados array<struct<titulo:string,autor:string,autor_visible_en_foto:boolean,nota:string>>")
    out = quality.assigned(answers, truth)
    assert [list(r.elegido) for r in out.collect()] == [[0]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan.split("Join")[0] and "regexp_replace" not in plan.split("Join", 1)[1]


def test_texts_of_lines_are_made_after_their_shuffle(spark):
    plan = A._line_books(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "upper(" in above and "upper(" not in below
    plan = A.lecturas(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "upper(" not in plan.split("Join", 1)[1]
