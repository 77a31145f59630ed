import json

from spinecat.sources import files, responses


def answers(spark, texts):
    return spark.createDataFrame(
        [("m", 1, i, t, 0.5, 100) for i, t in enumerate(texts)],
        "modelo string, lote_id long, foto_id long, texto string, costo double, latencia_ms long",
    )


BOOK = {
    "titulo_detectado": " RAYUELA ",
    "autor_detectado": "CORTAZAR",
    "titulo_corregido": "Rayuela",
    "autor_corregido": "Julio Cortázar",
    "confianza": 0.9,
}
DOC = json.dumps({"libros": [BOOK]})


def test_forms_of_an_answer(spark):
    texts = [
        DOC,
        f"```json\n{DOC}\n```",
        f"```\n{DOC}```",
        f"  {DOC}\n",
        DOC[:-4],
        "[]",
        '{"otros": []}',
        '{"libros": {}}',
        '{"libros": null}',
        '{"libros": []}',
        json.dumps({"libros": [5, BOOK, "x", None]}),
        f"Claro: {DOC} listo",
    ]
    good, failed = responses.parse(answers(spark, texts))
    assert sorted(r.foto_id for r in good.collect()) == [0, 1, 2, 3, 9, 10]
    assert {r.foto_id: r.motivo for r in failed.collect()} == {
        4: "json", 5: "objeto", 6: "clave", 7: "lista", 8: "lista", 11: "json",
    }
    lenient, _ = responses.parse(answers(spark, texts), lenient=True)
    assert {6, 11} <= {r.foto_id for r in lenient.collect()}
    rows, _ = responses.readings(responses.read(answers(spark, texts)))
    assert sorted(r.foto_id for r in rows.collect()) == [0, 1, 2, 3, 10]


def test_fallbacks_and_guard(spark):
    def book(**changes):
        return {**BOOK, **changes}

    books = [
        book(),
        book(titulo_corregido="", autor_corregido=None),
        book(autor_detectado="", autor_corregido="Diego Golombek"),
        book(autor_detectado="Coleccion X", autor_corregido="Z", confianza=0.1),
        book(autor_detectado="BUSQUED", autor_corregido="Carlos Busqued"),
        book(titulo_detectado="  "),
        book(confianza="0.8"),
        book(confianza=None),
        book(confianza="alta"),
        book(titulo_corregido=1984, confianza=True),
        book(titulo_detectado="0", titulo_corregido="false"),
    ]
    del books[7]["confianza"]
    rows, bad = responses.readings(
        responses.read(answers(spark, [json.dumps({"libros": books})]))
    )
    got = {r.pos: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    assert [r.pos for r in bad.collect()] == [8]
    assert (got[0].titulo_detectado, got[0].autor_corregido) == ("RAYUELA", "Julio Cortázar")
    assert (got[1].titulo_corregido, got[1].autor_corregido) == ("RAYUELA", "")
    assert (got[2].autor_corregido, got[2].confianza, got[2].autor_descartado) == ("", 0.4, "Diego Golombek")
    assert (got[3].autor_corregido, got[3].confianza, got[3].autor_descartado) == ("", 0.1, "Z")
    assert (got[4].autor_corregido, got[4].confianza, got[4].autor_descartado) == ("Carlos Busqued", 0.9, None)
    assert got[6].confianza == 0.8 and got[7].confianza == 0.0
    assert (got[9].titulo_corregido, got[9].confianza) == ("1984", 1.0)
    assert (got[10].titulo_detectado, got[10].titulo_corregido) == ("0", "false")


def test_texts_are_parsed_once_and_members_read_together(spark):
    """No filter repeats the parsing of the truth, and no book's whole type is worked out."""
    docs = spark.createDataFrame([('{"1": [{"titulo": "t", "autor": "a"}], "2": []}',)], "texto string")
    photos = files.truth_photos(docs)
    assert photos._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((r.foto, len(r.esperados)) for r in photos.collect()) == [("1", 1), ("2", 0)]
    odd = '[1, null, [], "x", {}, {"titulo_corregido": {"a": 1}, "titulo_detectado": 7, "autor_detectado": null, "confianza": "x"}]'
    answers = responses.read(spark.createDataFrame([(1, f'{{"libros": {odd}}}')], "foto_id long, texto string"))
    books = responses.books(answers).select("foto_id", "libros")
    told = books._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in told.lower().replace("schemaofvariant", "schema_of_variant")
    got = [(b.pos, b.titulo, b.autor, b.confianza) for b in books.first().libros]
    assert got == [(4, "", "", 0.0), (5, '{"a":1}', "", None)]
