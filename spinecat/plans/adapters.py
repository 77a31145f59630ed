"""The stored tables of the catalogue, derived from the TPC-H-like test tables.

Every view is a plain projection or an equi join of whole tables, so its work grows with
them. The same definitions in SQL are in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import text

FOLD_FROM = "1995-01-01"
FOLD_TO = "2024-01-01"
ARCHIVED = "2024-02-15"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shop_count(spark: SparkSession, sf: str) -> Column:
    """Number of shops as a scalar subquery; answered from the file footers."""
    return table(spark, sf, "supplier").agg(F.count("*")).scalar()


def folded_day(col: Column | str) -> Column:
    """Move a date into January 2024, keeping its position in a 30-day cycle."""
    days = F.pmod(F.date_diff(F.to_date(col), F.lit(FOLD_FROM).cast("date")), F.lit(30))
    return F.date_add(F.lit(FOLD_TO).cast("date"), days).cast("timestamp")


def shift(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL {days} DAYS")


def digest_id(*cols: Column) -> Column:
    """60-bit row id without a shuffle: the test tables bring no key of their own."""
    joined = F.concat_ws("|", *cols)
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def librerias(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        text.slug("s_name").alias("slug"),
        F.col("s_name").alias("nombre"),
        F.concat(F.lit("549"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias(
            "whatsapp"
        ),
        F.lit(schemas.DEFAULT_TEMPLATE).alias("mensaje_wa_template"),
        F.date_add(F.lit("2023-12-01").cast("date"), (F.col("s_suppkey") % 28).cast("int"))
        .cast("timestamp")
        .alias("creado_en"),
        (F.col("s_acctbal") >= 0).alias("activa"),
    )


def _batch_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    estado = (
        F.when(F.col("o_orderstatus") == "F", "publicado")
        .when(F.col("o_orderstatus") == "O", "revision")
        .when(F.col("o_orderpriority") == "5-LOW", "descartado")
        .otherwise("procesando")
    )
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.pmod(F.col("o_custkey"), shop_count(spark, sf)).alias("libreria_id"),
        estado.alias("estado"),
        folded_day("o_orderdate").alias("creado_en"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT", F.lit(ARCHIVED).cast("timestamp")
        ).alias("archivado_en"),
    )


def lotes(spark: SparkSession, sf: str) -> DataFrame:
    base = _batch_columns(spark, sf)
    photos = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("lote"))
        .agg(F.countDistinct("l_linenumber").alias("n"))
    )
    return base.join(photos, base.id == photos.lote, "left").select(
        "id",
        "libreria_id",
        "estado",
        F.coalesce("n", F.lit(0)).alias("cant_fotos"),
        "creado_en",
        F.when(F.col("estado") == "publicado", shift(F.col("creado_en"), 1)).alias(
            "publicado_en"
        ),
        "archivado_en",
    )


def fotos(spark: SparkSession, sf: str) -> DataFrame:
    distinct = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return distinct.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("lote_id"),
        F.concat(
            F.col("l_orderkey").cast("string"),
            F.lit("/"),
            (F.col("l_linenumber") - 1).cast("string"),
            F.lit(".jpg"),
        ).alias("path"),
        (F.col("l_linenumber") - 1).cast("int").alias("orden"),
    )


def _cents(name: str) -> Column:
    return F.floor(F.col(name) * 100 + 0.5).cast("string")


def _lines(lineitem: DataFrame) -> DataFrame:
    """Book columns that need only a line, next to the columns its texts are made of."""
    key = F.col("l_partkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    estado = (
        F.when((flag == "R") & (status == "O"), "pendiente")
        .when((flag == "R") & (status == "F"), "descartado")
        .when((flag == "N") & (status == "O"), "vendido")
        .otherwise("publicado")
    )
    return lineitem.select(
        digest_id(
            F.col("l_orderkey").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            _cents("l_quantity"),
            _cents("l_extendedprice"),
            _cents("l_discount"),
            _cents("l_tax"),
            flag,
            status,
            F.to_date("l_shipdate").cast("string"),
        ).alias("id"),
        F.col("l_orderkey").alias("lote_id"),
        "l_partkey",
        "l_linenumber",
        (F.col("l_suppkey") % 3 == 0).alias("en_mayusculas"),
        (F.floor(F.col("l_discount") * 100 + 0.5) / 10).alias("confianza"),
        estado.alias("estado"),
        ((estado == "descartado") & (key % 2 == 0)).alias("repetido"),
        folded_day("l_shipdate").alias("creado_en"),
    )


def _with_part(lines: DataFrame, part: DataFrame) -> DataFrame:
    named = part.select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return lines.join(named, lines.l_partkey == named.p_partkey)


def _with_texts(rows: DataFrame, *more: str) -> DataFrame:
    """Texts are made where they are used, as they are longer than what they are made of."""
    key = F.col("l_partkey")
    title = (
        F.when(key % 4 == 0, F.replace(F.col("p_name"), F.lit("a"), F.lit("á")))
        .when(key % 4 == 1, F.concat(F.upper("p_name"), F.lit(".")))
        .when(key % 4 == 2, F.concat_ws(": ", F.col("p_name"), F.lower("p_type")))
        .otherwise(F.concat_ws(" ", F.col("p_name"), F.col("p_size").cast("string")))
    )
    author = F.when(key % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("Ana "), F.lower("p_type"))
    )
    return rows.select(
        "id",
        "lote_id",
        (F.col("lote_id") * 10 + F.col("l_linenumber")).alias("foto_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("orden"),
        F.when(F.col("en_mayusculas"), F.upper(title)).otherwise(title).alias("titulo_raw"),
        author.alias("autor_raw"),
        title.alias("titulo"),
        author.alias("autor"),
        "confianza",
        "estado",
        "repetido",
        "creado_en",
        F.when(
            key % 7 == 1, F.concat(F.lit("Coleccion "), F.col("p_brand"))
        ).when(key % 7 == 0, F.lit("")).otherwise(author).alias("autor_leido"),
        *more,
    )


def _book_rows(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Book columns that need only a line and its part."""
    return _with_texts(_with_part(_lines(lineitem), part))


def _line_books(spark: SparkSession, sf: str, batches: DataFrame | None = None) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    if batches is not None:
        # Before the texts are made and shuffled.
        lines = lines.join(batches.select(F.col("lote_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    # By batch, as the joins and groups that follow need it.
    return _with_texts(_with_part(_lines(lines), table(spark, sf, "part")).repartition("lote_id"))


def libros(spark: SparkSession, sf: str) -> DataFrame:
    """Book table; ``duplicado_de`` of a repeated book is the first id of its batch.

    The aggregate behind ``duplicado_de`` is unique per batch, so the optimizer removes its
    join wherever the column is not used.
    """
    rows = _line_books(spark, sf)
    batches = _batch_columns(spark, sf).select(
        F.col("id").alias("lote"), "libreria_id", "archivado_en"
    )
    firsts = rows.groupBy(F.col("lote_id").alias("lote_f")).agg(F.min("id").alias("primero"))
    joined = rows.join(batches, rows.lote_id == batches.lote).join(
        firsts, rows.lote_id == firsts.lote_f, "left"
    )
    live = F.col("estado").isin(schemas.INVENTORY_STATES)
    return joined.select(
        "id",
        "libreria_id",
        "lote_id",
        "foto_id",
        "orden",
        "titulo_raw",
        "autor_raw",
        "titulo",
        "autor",
        "confianza",
        "estado",
        "creado_en",
        F.when(live, shift(F.col("creado_en"), 1)).alias("publicado_en"),
        F.when(F.col("estado") == "vendido", shift(F.col("creado_en"), 7)).alias("vendido_en"),
        F.when(F.col("repetido") & (F.col("primero") != F.col("id")), F.col("primero")).alias(
            "duplicado_de"
        ),
        "archivado_en",
        "autor_leido",
    )


def event_rows(events: DataFrame, shops: Column) -> DataFrame:
    """Event log from the raw ``events`` rows, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    ks = k.cast("string")
    kind = F.col("event_type")
    tipo = (
        F.when(kind == "view", "vista")
        .when(kind == "click", "clic_whatsapp")
        .when(kind == "error", "busqueda")
        .when(kind == "signup", "lote_publicado")
        .when(k % 2 == 0, "scan_qr")
        .otherwise("inventario_reiniciado")
    )
    j = F.concat
    payload = (
        F.when(
            tipo == "vista",
            F.when(k % 3 == 0, F.lit('{"src":"qr"}')).otherwise(F.lit('{"src":"link"}')),
        )
        .when(
            tipo == "busqueda",
            F.when(
                k % 10 == 9, j(F.lit('{"q":" Term'), (k % 20).cast("string"), F.lit(' "}'))
            ).otherwise(
                j(
                    F.lit('{"q":" Term'),
                    (k % 20).cast("string"),
                    F.lit(' ","resultados":'),
                    F.when(k % 20 == 1, F.lit('"1"')).when(k % 20 == 2, F.lit("true")).otherwise((k % 4).cast("string")),
                    F.lit("}"),
                )
            ),
        )
        .when(
            tipo == "clic_whatsapp",
            F.when(k % 5 == 0, F.lit('{"libro_id":null,"generico":true,"q":"t"}'))
            .when(k % 5 == 1, j(F.lit('{"libro_id":'), ks, F.lit(',"titulo":"","generico":false}')))
            .when(k % 30 == 7, j(F.lit('{"libro_id":'), ks, F.lit(',"titulo":1984}')))
            .otherwise(
                j(
                    F.lit('{"libro_id":'),
                    ks,
                    F.lit(',"titulo":"Libro '),
                    (k % 30).cast("string"),
                    F.lit('"}'),
                )
            ),
        )
        .when(
            tipo == "lote_publicado",
            j(
                F.lit('{"lote_id":'),
                ks,
                F.lit(',"publicados":'),
                (k % 12).cast("string"),
                F.lit("}"),
            ),
        )
        .when(
            tipo == "inventario_reiniciado", j(F.lit('{"libros_archivados":'), ks, F.lit("}"))
        )
        .otherwise(F.lit("{}"))
    )
    session = (
        F.when(tipo.isin("lote_publicado", "inventario_reiniciado"), F.lit(None))
        .when(k % 13 == 0, F.lit(""))
        .otherwise(
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
        )
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.pmod(F.col("user_id"), shops).alias("libreria_id"),
        tipo.alias("tipo"),
        payload.alias("payload"),
        session.alias("session_id"),
        F.col("ts").cast("timestamp").alias("creado_en"),
    )


def eventos(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(table(spark, sf, "events"), shop_count(spark, sf))


def raw_events(log: DataFrame, shops: DataFrame) -> DataFrame:
    """What browsers send: the slug instead of the shop id; every 17th slug is unknown."""
    names = shops.select(F.col("id").alias("tienda"), "slug")
    return log.join(names, log.libreria_id == names.tienda).select(
        "id",
        F.when(F.col("id") % 17 == 0, F.lit("no-existe")).otherwise(F.col("slug")).alias("slug"),
        "tipo",
        "payload",
        "session_id",
        "creado_en",
    )


def eventos_raw(spark: SparkSession, sf: str) -> DataFrame:
    return raw_events(eventos(spark, sf), librerias(spark, sf))


def _readings(lines: DataFrame, batches: DataFrame, part: DataFrame) -> DataFrame:
    """Lines meet their batch before they have texts, which are not shuffled."""
    placed = lines.join(batches, lines.lote_id == batches.lote)
    return _with_texts(_with_part(placed, part), "libreria_id").select(
        "id",
        "libreria_id",
        "lote_id",
        "foto_id",
        "orden",
        F.col("titulo_raw").alias("titulo_detectado"),
        F.col("autor_leido").alias("autor_detectado"),
        F.col("titulo").alias("titulo_corregido"),
        F.col("autor").alias("autor_corregido"),
        "confianza",
    )


def lecturas(spark: SparkSession, sf: str) -> DataFrame:
    """Every book row as one reading of a photo, ordered by batch, photo and id."""
    batches = _batch_columns(spark, sf).select(F.col("id").alias("lote"), "libreria_id")
    return _readings(_lines(table(spark, sf, "lineitem")), batches, table(spark, sf, "part"))


def respuestas(spark: SparkSession, sf: str, batches: DataFrame | None = None) -> DataFrame:
    """One model answer per photo: a JSON document, some fenced, some cut short.

    Some corrected titles are blank, some empty. ``batches`` (lote_id) leaves out the answers of others.
    """
    size = F.length("titulo") % 13
    book = F.struct(
        "id",
        F.struct(
            F.col("titulo_raw").alias("titulo_detectado"),
            F.col("autor_leido").alias("autor_detectado"),
            F.when(size == 5, F.lit("   ")).when(size == 6, F.lit("")).otherwise(F.col("titulo")).alias("titulo_corregido"),
            F.col("autor").alias("autor_corregido"),
            "confianza",
        ).alias("libro"),
    )
    grouped = (
        _line_books(spark, sf, batches)
        .groupBy("foto_id", "lote_id")
        .agg(F.sort_array(F.collect_list(book)).alias("b"))
    )
    body = F.to_json(F.struct(F.col("b.libro").alias("libros")))
    photo = F.col("foto_id")
    return grouped.select(
        F.concat(F.lit("modelo-"), (photo % 4).cast("string")).alias("modelo"),
        "lote_id",
        "foto_id",
        F.when(photo % 17 == 0, F.substr(body, F.lit(1), F.length(body) - 5))
        .when(photo % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
        .alias("texto"),
        (F.size("b") * F.lit(0.001)).alias("costo"),
        (F.lit(500) + photo % 1000).alias("latencia_ms"),
    )


def verdad(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled truth: per batch one JSON map photo -> expected books."""
    book = F.struct(
        "id",
        F.struct(
            F.col("titulo"),
            F.col("autor"),
            (F.col("autor") != "").alias("autor_visible_en_foto"),
        ).alias("libro"),
    )
    photos = (
        _line_books(spark, sf)
        .groupBy("lote_id", "foto_id")
        .agg(F.sort_array(F.collect_list(book), asc=False).alias("b"))
    )
    return photos.select(
        "lote_id",
        F.to_json(F.create_map(F.col("foto_id").cast("string"), F.col("b.libro"))).alias("texto"),
    )


def ediciones(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on books: one for each book, a later one for those not in the inventory."""
    books = libros(spark, sf).select("id", "titulo", "autor", "estado", "orden", "creado_en")
    states = F.array(*[F.lit(s) for s in [*schemas.BOOK_STATES, "perdido"]])
    first = books.select(
        F.col("id").alias("libro_id"),
        F.concat(F.lit("  "), F.col("titulo"), F.lit(" ")).alias("titulo"),
        F.concat(F.col("autor"), F.lit(" ")).alias("autor"),
        F.get(states, F.col("orden") % 5).alias("estado"),
        shift(F.col("creado_en"), 2).alias("ts"),
    )
    later = books.filter(~F.col("estado").isin(schemas.INVENTORY_STATES)).select(
        F.col("id").alias("libro_id"),
        F.concat(F.col("titulo"), F.lit(" II")).alias("titulo"),
        F.col("autor"),
        F.when(F.col("estado") == "pendiente", "publicado").otherwise("vendido").alias("estado"),
        shift(F.col("creado_en"), 4).alias("ts"),
    )
    refused = books.filter(F.col("orden") % 3 == 1).select(
        F.col("id").alias("libro_id"),
        F.concat(F.col("titulo"), F.lit(" III")).alias("titulo"),
        F.col("autor"),
        F.lit("perdido").alias("estado"),
        shift(F.col("creado_en"), 6).alias("ts"),
    )
    return first.unionByName(later).unionByName(refused)


def altas(spark: SparkSession, sf: str) -> DataFrame:
    """Shop sign-ups in order of arrival; some clash with each other or with known shops."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 9, "0")
    return c.select(
        key.alias("solicitud"),
        F.when(key % 10 == 7, F.concat(F.lit("  Sup#"), digits))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
        .alias("nombre"),
        F.when(key % 9 == 4, F.lit("011-4444-5555"))
        .when(key % 9 == 5, F.concat(F.lit(" 54"), digits))
        .when(key % 9 == 6, digits)
        .otherwise(F.concat(F.lit("549"), digits))
        .alias("whatsapp"),
        F.when(key % 10 == 3, F.concat(F.lit("Supplier "), digits))
        .when(key % 10 == 5, F.col("c_mktsegment"))
        .otherwise(F.lit(""))
        .alias("slug"),
        F.when(key % 4 == 0, F.lit(" "))
        .when(key % 4 == 1, F.lit("Hola {titulo} "))
        .otherwise(F.lit(schemas.DEFAULT_TEMPLATE))
        .alias("mensaje_wa_template"),
    )


def consultas(spark: SparkSession, sf: str) -> DataFrame:
    """Search box entries: one for each search event, aimed at titles and authors."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    total = table(spark, sf, "part").agg(F.count("*")).scalar()
    searches = table(spark, sf, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = searches.select(
        F.col("event_id").alias("consulta_id"),
        F.pmod(F.col("user_id"), shop_count(spark, sf)).alias("libreria_id"),
        k.alias("k"),
        F.pmod(F.col("event_id"), total).alias("parte"),
    )
    joined = rows.join(parts, rows.parte == parts.p_partkey)
    q = (
        F.when(F.col("k") % 10 == 9, F.lit("   "))
        .when(F.col("k") % 5 == 0, F.replace(F.upper("p_name"), F.lit("A"), F.lit("Á")))
        .when(F.col("k") % 5 == 1, F.expr("right(p_name, 5)"))
        .when(F.col("k") % 5 == 2, F.concat(F.lit("na "), F.lower(F.substring("p_type", 1, 4))))
        .when(F.col("k") % 5 == 3, F.expr("left(p_name, 2)"))
        .otherwise(
            F.concat(F.lit(" Term"), (F.col("k") % 20).cast("string"), F.lit(" "))
        )
    )
    return joined.select("consulta_id", "libreria_id", q.alias("q"))


def registro_llamadas(spark: SparkSession, sf: str) -> DataFrame:
    """Service log lines, one for each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    ks = k.cast("string")
    batch = F.col("event_id").cast("string")
    model = F.concat(F.lit("modelo-"), (F.col("user_id") % 4).cast("string"))
    j = F.concat
    ok = j(
        F.lit("INFO vision_ok intento="),
        (k % 2 + 1).cast("string"),
        F.lit(" modelo="),
        model,
        F.lit(" latencia_ms="),
        (k * 10 + 500).cast("string"),
        F.lit(" tokens={'prompt_tokens': "),
        (k + 1000).cast("string"),
        F.lit(", 'completion_tokens': "),
        (k * 3).cast("string"),
        F.lit(", 'cost': 0.00"),
        (k % 9 + 1).cast("string"),
        F.lit("} respuesta='{}'"),
    )
    failed = j(
        F.lit("WARNING vision_fallo intento="),
        (k % 2 + 1).cast("string"),
        F.lit(" modelo="),
        model,
        F.lit(" latencia_ms="),
        (k * 20 + 900).cast("string"),
        F.lit(" error=JSON invalido"),
    )
    done = j(
        F.lit("INFO lote_procesado lote_id="),
        batch,
        F.lit(" libreria_id="),
        F.col("user_id").cast("string"),
        F.lit(" nuevos="),
        (k % 40).cast("string"),
        F.lit(" duplicados="),
        (k % 7).cast("string"),
    )
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.when(kind.isin("view", "click", "error"), ok)
        .when(kind == "signup", done)
        .when(k % 3 == 0, failed)
        .otherwise(j(F.lit("INFO otra cosa "), ks))
        .alias("value")
    )


# --- streams ------------------------------------------------------------------------------


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table as a file stream; the last letter is a pattern so that a plain file works."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def stream_eventos(spark: SparkSession, sf: str) -> DataFrame:
    shops = F.lit(table(spark, sf, "supplier").count())
    return event_rows(stream_table(spark, sf, "events"), shops)


def stream_raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return raw_events(stream_eventos(spark, sf), librerias(spark, sf))


def stream_lecturas(spark: SparkSession, sf: str) -> DataFrame:
    shops = F.lit(table(spark, sf, "supplier").count())
    batches = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("lote"), F.pmod("o_custkey", shops).alias("libreria_id")
    )
    return _readings(_lines(stream_table(spark, sf, "lineitem")), batches, table(spark, sf, "part"))


def stream_libros(spark: SparkSession, sf: str) -> DataFrame:
    rows = _book_rows(stream_table(spark, sf, "lineitem"), table(spark, sf, "part"))
    return rows.select(
        "lote_id", "foto_id", F.when(F.col("repetido"), F.col("lote_id")).alias("duplicado_de")
    )
