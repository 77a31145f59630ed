"""Decisions on books, batches and shops as table-to-table transforms.

Parquet tables have no row updates, so each operator takes the current table and a table of
decisions and returns the next table. Event rows use the stored event columns without id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import text
from spinecat.operators.catalog import approved
from spinecat.operators.joins import join_unique

def _spread(reference: str, row_id: str = "id") -> Column:
    """Join key for an optional reference: rows without one get a key of their own.

    NULL keys would all hash to one task; a negative row number never matches and spreads.
    """
    return F.coalesce(F.col(reference), -F.col(row_id) - 1)


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def split_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits with a known state, rejected edits with a reason)."""
    good = F.coalesce(F.col("estado").isin(schemas.BOOK_STATES), F.lit(False))
    return edits.filter(good), edits.filter(~good).withColumn("motivo", F.lit("estado"))


def apply_edits(books: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (libro_id, titulo, autor, estado, ts) edits; any state may follow any state.

    The last edit of a book decides its texts and state; every edit to published or sold
    stamps its date, so the stamps come from the last edit of that kind. One aggregate per
    book gives the same row as applying the edits one after the other.
    """
    valid, rejected = split_edits(edits)
    last = F.struct("titulo", "autor", "estado")
    per_book = valid.groupBy(F.col("libro_id").alias("id")).agg(
        F.max_by(last, F.struct("ts", "estado", "titulo", "autor")).alias("e"),
        F.max(F.when(F.col("estado") == "publicado", F.col("ts"))).alias("e_publicado"),
        F.max(F.when(F.col("estado") == "vendido", F.col("ts"))).alias("e_vendido"),
    )
    joined = books.join(per_book, "id", "left")
    edited = F.col("e").isNotNull()
    result = joined.withColumns(
        {
            "titulo": F.when(edited, text.strip("e.titulo")).otherwise(F.col("titulo")),
            "autor": F.when(edited, text.strip(text.or_empty("e.autor"))).otherwise(F.col("autor")),
            "estado": F.coalesce("e.estado", "estado"),
            "publicado_en": F.coalesce("e_publicado", "publicado_en"),
            "vendido_en": F.coalesce("e_vendido", "vendido_en"),
        }
    )
    return result.select(*books.columns), rejected


def review_edits(books: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """Edits a review sends: (lote_id, accion) publishes approved books and drops the rest.

    A decision may carry overrides as a map book id -> approved; the confidence decides
    otherwise. Discarding a batch drops every book of it.
    """
    rows = books.filter(F.col("duplicado_de").isNull()).join(decisions, "lote_id")
    ok = (F.col("accion") == "publicar") & approved("confianza")
    if "aprobados" in decisions.columns:
        ok = (F.col("accion") == "publicar") & F.coalesce(
            F.try_element_at("aprobados", F.col("id")), approved("confianza")
        )
    return rows.select(
        F.col("id").alias("libro_id"),
        "titulo",
        "autor",
        F.when(ok, "publicado").otherwise("descartado").alias("estado"),
        _now(now).alias("ts"),
    )


def review_books(books: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """The books after the edits of ``review_edits``, in one join with the decisions."""
    marks = decisions.withColumnRenamed("lote_id", "lote_decidido")
    joined = join_unique(
        books.withColumn("lote_decidido", _spread("lote_id")), marks, ["lote_decidido"]
    )
    ok = approved("confianza")
    if "aprobados" in decisions.columns:
        ok = F.coalesce(F.try_element_at("aprobados", F.col("id")), ok)
    target = F.when((F.col("accion") == "publicar") & ok, "publicado").otherwise("descartado")
    hit = F.col("accion").isNotNull() & F.col("duplicado_de").isNull()
    return _edited(joined, hit, _now(now), books.columns, estado=target)


def _edited(rows: DataFrame, hit: Column, now: Column, columns: list[str], **changes: Column) -> DataFrame:
    """Rows as one edit leaves them where ``hit``: texts stripped, state set, its date stamped."""
    estado = changes.get("estado", F.col("estado"))
    title, author = changes.get("titulo", F.col("titulo")), changes.get("autor", F.col("autor"))
    new = {
        "titulo": text.strip(title),
        "autor": text.strip(text.or_empty(author)),
        "estado": estado,
        "publicado_en": F.when(estado == "publicado", now).otherwise(F.col("publicado_en")),
        "vendido_en": F.when(estado == "vendido", now).otherwise(F.col("vendido_en")),
    }
    marked = F.coalesce(hit, F.lit(False))
    return rows.withColumns(
        {k: F.when(marked, v).otherwise(F.col(k)) for k, v in new.items()}
    ).select(*columns)


def _asked(books: DataFrame, ids: DataFrame) -> DataFrame:
    return books.join(ids.select("id").distinct().withColumn("pedido", F.lit(True)), "id", "left")


def sell_books(books: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """The books with those of ``ids`` (id) sold, in one join."""
    return _edited(_asked(books, ids), F.col("pedido"), _now(now), books.columns, estado=F.lit("vendido"))


def restored_books(books: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """The books with the model's own reading back in those of ``ids``, in one join."""
    return _edited(
        _asked(books, ids), F.col("pedido"), _now(now), books.columns,
        titulo=F.col("titulo_raw"), autor=F.col("autor_raw"),
    )


def mark_sold(books: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Edits that sell the books of ``ids`` (id)."""
    return books.join(ids.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("libro_id"),
        "titulo",
        "autor",
        F.lit("vendido").alias("estado"),
        _now(now).alias("ts"),
    )


def restore_raw(books: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Edits that put the model's own reading back, state unchanged."""
    return books.join(ids.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("libro_id"),
        F.col("titulo_raw").alias("titulo"),
        F.col("autor_raw").alias("autor"),
        "estado",
        _now(now).alias("ts"),
    )


def _settle(books: DataFrame, batch_ids: DataFrame, estado: str, now: Column) -> DataFrame:
    """Give the still pending books of the batches a state; rows without a batch pass."""
    ids = batch_ids.select(F.col("id").alias("lote_hecho")).distinct()
    joined = join_unique(
        books.withColumn("lote_hecho", _spread("lote_id")),
        ids.withColumn("hecho", F.lit(True)),
        ["lote_hecho"],
    )
    hit = F.col("hecho").isNotNull() & (F.col("estado") == "pendiente")
    result = joined.withColumn("toca", hit)
    if estado == "publicado":
        result = result.withColumn(
            "publicado_en", F.when(F.col("toca"), now).otherwise(F.col("publicado_en"))
        )
    result = result.withColumn(
        "estado", F.when(F.col("toca"), estado).otherwise(F.col("estado"))
    )
    return result.select(*books.columns)


def _close(batches: DataFrame, batch_ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    ids = batch_ids.select("id").distinct().withColumn("hecho", F.lit(True))
    joined = batches.join(ids, "id", "left")
    for name, value in changes.items():
        joined = joined.withColumn(
            name, F.when(F.col("hecho"), value).otherwise(F.col(name))
        )
    return joined.select(*batches.columns)


def close_processing(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Processed batches go to review, also when they brought no book."""
    return _close(batches, done, {"estado": F.lit("revision")})


def publish(
    books: DataFrame, batches: DataFrame, batch_ids: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, batches, events): pending books go public and each batch logs its count."""
    at = _now(now)
    known = batches.join(batch_ids.select("id").distinct(), "id", "left_semi")
    new_books = _settle(books, known, "publicado", at)
    new_batches = _close(
        batches, known, {"estado": F.lit("publicado"), "publicado_en": at}
    )
    counts = (
        new_books.filter((F.col("estado") == "publicado") & F.col("lote_id").isNotNull())
        .groupBy(F.col("lote_id").alias("id"))
        .agg(F.count("*").alias("n"))
    )
    events = known.join(counts, "id", "left").select(
        "libreria_id",
        F.lit("lote_publicado").alias("tipo"),
        F.to_json(
            F.struct(
                F.col("id").alias("lote_id"), F.coalesce("n", F.lit(0)).alias("publicados")
            )
        ).alias("payload"),
        F.lit(None).cast("string").alias("session_id"),
        at.alias("creado_en"),
    )
    return new_books, new_batches, events


def discard(
    books: DataFrame, batches: DataFrame, batch_ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    known = batches.join(batch_ids.select("id").distinct(), "id", "left_semi")
    return (
        _settle(books, known, "descartado", F.lit(None)),
        _close(batches, known, {"estado": F.lit("descartado")}),
    )


def reset(
    books: DataFrame, batches: DataFrame, shop_ids: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, batches, events): archive everything the shops still have open."""
    at = _now(now)
    ids = shop_ids.select(F.col("id").alias("libreria_id")).distinct()
    marked = ids.withColumn("reinicia", F.lit(True))

    def archived(df: DataFrame) -> DataFrame:
        stamp = F.when(F.col("reinicia"), F.coalesce("archivado_en", at)).otherwise(
            F.col("archivado_en")
        )
        joined = join_unique(df, marked, ["libreria_id"])
        return joined.withColumn("archivado_en", stamp).select(*df.columns)

    counts = (
        books.filter(F.col("archivado_en").isNull())
        .groupBy("libreria_id")
        .agg(F.count("*").alias("n"))
    )
    events = ids.join(counts, "libreria_id", "left").select(
        "libreria_id",
        F.lit("inventario_reiniciado").alias("tipo"),
        F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("libros_archivados"))).alias(
            "payload"
        ),
        F.lit(None).cast("string").alias("session_id"),
        at.alias("creado_en"),
    )
    return archived(books), archived(batches), events


def _clear(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Null a reference to removed rows."""
    ids = gone.select(F.col("id").alias("quitado")).distinct()
    joined = join_unique(
        df.withColumn("quitado", _spread(column)),
        ids.withColumn("falta", F.lit(True)),
        ["quitado"],
    )
    return joined.withColumn(
        column, F.when(F.col("falta").isNull(), F.col(column))
    ).select(*df.columns)


def delete_books(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove books; repeats that pointed to one of them lose the pointer."""
    kept = books.join(ids.select("id"), "id", "left_anti")
    return _clear(kept, "duplicado_de", ids)


def delete_shops(tables: dict[str, DataFrame], shop_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove shops with everything that hangs on them.

    A shop takes along its batches, their photos, its books and its events. References from
    rows of other shops to removed rows become NULL.
    """
    ids = shop_ids.select(F.col("id").alias("libreria_id")).distinct()
    batches, books = tables["lotes"], tables["libros"]
    gone_batches = join_unique(batches, ids, ["libreria_id"], "left_semi").select("id")
    gone_photos = join_unique(
        tables["fotos"], gone_batches.withColumnRenamed("id", "lote_id"), ["lote_id"], "left_semi"
    ).select("id")
    gone_books = join_unique(books, ids, ["libreria_id"], "left_semi").select("id")
    kept_books = join_unique(books, ids, ["libreria_id"], "left_anti").select(*books.columns)
    for column, gone in (
        ("lote_id", gone_batches),
        ("foto_id", gone_photos),
        ("duplicado_de", gone_books),
    ):
        kept_books = _clear(kept_books, column, gone)
    return {
        "librerias": tables["librerias"].join(
            shop_ids.select("id"), "id", "left_anti"
        ),
        "lotes": join_unique(batches, ids, ["libreria_id"], "left_anti").select(*batches.columns),
        "fotos": join_unique(
            tables["fotos"], gone_batches.withColumnRenamed("id", "lote_id"), ["lote_id"], "left_anti"
        ).select(*tables["fotos"].columns),
        "libros": kept_books,
        "eventos": join_unique(tables["eventos"], ids, ["libreria_id"], "left_anti").select(
            *tables["eventos"].columns
        ),
    }
