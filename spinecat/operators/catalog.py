"""Public catalogue, inventory and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import text
from spinecat.operators.pages import json_pages, numbered
from spinecat.session import materialise


def active(shops: DataFrame) -> DataFrame:
    return shops.filter("activa")


def _live() -> Column:
    return F.col("archivado_en").isNull()


def public_books(books: DataFrame) -> DataFrame:
    return books.filter((F.col("estado") == "publicado") & _live())


def inventory_books(books: DataFrame) -> DataFrame:
    return books.filter(F.col("estado").isin(schemas.INVENTORY_STATES) & _live())


def indexed_books(books: DataFrame) -> DataFrame:
    """Books a new reading may repeat; discarded ones deserve a second chance."""
    return books.filter(F.col("estado").isin(schemas.INDEXED_STATES) & _live())


def new_books(books: DataFrame) -> DataFrame:
    return books.filter(F.col("duplicado_de").isNull())


def repeated_books(books: DataFrame) -> DataFrame:
    return books.filter(F.col("duplicado_de").isNotNull())


def published_counts(books: DataFrame) -> DataFrame:
    return public_books(books).groupBy("libreria_id").agg(F.count("*").alias("cant_libros"))


def shop_book_counts(shops: DataFrame, books: DataFrame) -> DataFrame:
    """Every active shop with its published books; ``puesto`` is its place, newest shop first.

    Books are counted before the join, so one row per shop crosses it.
    """
    counts = published_counts(books)
    known = active(shops).select(F.col("id").alias("libreria_id"), "slug", "nombre", "creado_en")
    joined = known.join(counts, "libreria_id", "left").fillna(0, ["cant_libros"])
    placed = numbered(joined, [], [F.desc("creado_en"), F.col("libreria_id")])
    return placed.withColumnRenamed("numero", "puesto")


def review_queue(batches: DataFrame, books: DataFrame) -> DataFrame:
    """Batches waiting for review with their non-repeated books; ``puesto`` is their place, newest first."""
    counts = (
        new_books(books)
        .filter(F.col("lote_id").isNotNull())
        .groupBy(F.col("lote_id").alias("id"))
        .agg(F.count("id").alias("cant_libros"))
    )
    waiting = batches.filter((F.col("estado") == "revision") & _live())
    joined = waiting.join(counts, "id", "left").fillna(0, ["cant_libros"])
    listed = joined.select("id", "libreria_id", "cant_fotos", "creado_en", "cant_libros")
    placed = numbered(listed, ["libreria_id"], [F.desc("creado_en"), F.desc("id")])
    return placed.withColumnRenamed("numero", "puesto")


def public_catalog(shops: DataFrame, books: DataFrame) -> DataFrame:
    """Published books of active shops, by title."""
    names = active(shops).select(F.col("id").alias("libreria_id"), "slug")
    rows = public_books(books).join(names, "libreria_id")
    return rows.select(
        "slug", "id", "titulo", "autor", text.iso_date("creado_en").alias("visto")
    )


def catalog_documents(
    shops: DataFrame, books: DataFrame, page_size: int = schemas.PAGE_SIZE
) -> DataFrame:
    """One JSON array per shop and page, in title order."""
    record = F.struct("id", "titulo", "autor", "visto")
    return json_pages(
        public_catalog(shops, books), ["slug"], ["titulo", "id"], record, page_size
    )


def inventory(books: DataFrame) -> DataFrame:
    return inventory_books(books).select("libreria_id", "id", "titulo", "autor", "estado")


def review_flags(books: DataFrame) -> DataFrame:
    """Pre-approved and corrected marks of the books to review."""
    return new_books(books).select(
        "id",
        "lote_id",
        "foto_id",
        "titulo",
        "autor",
        "confianza",
        approved("confianza").alias("aprobado"),
        was_corrected().alias("corregido"),
    )


def approved(confidence: Column | str) -> Column:
    level = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.coalesce(level, F.lit(0.0)) >= F.lit(schemas.CONFIDENCE_GATE)


def was_corrected() -> Column:
    return (F.col("titulo") != F.col("titulo_raw")) | (
        text.or_empty("autor") != text.or_empty("autor_raw")
    )


# Sort orders of the lists; the id makes each of them total.

def by_title() -> list[Column]:
    return [F.asc("titulo"), F.asc("id")]


def by_confidence() -> list[Column]:
    return [F.asc("confianza"), F.asc("id")]


def by_photo_then_confidence() -> list[Column]:
    return [F.asc("foto_id"), F.asc("confianza"), F.asc("id")]


def by_photo_then_title() -> list[Column]:
    return [F.asc("foto_id"), F.asc("titulo"), F.asc("id")]


def for_display() -> list[Column]:
    """Confident readings of a photo first, then the doubtful ones."""
    return [F.asc("foto_id"), F.desc(approved("confianza")), F.asc("confianza"), F.asc("id")]


def newest_first() -> list[Column]:
    return [F.desc("creado_en"), F.desc("id")]


def batch_status(
    batches: DataFrame, books: DataFrame, page_size: int = schemas.PAGE_SIZE
) -> DataFrame:
    """State, progress and book list of each batch."""
    progress = books.groupBy(F.col("lote_id").alias("id")).agg(
        F.countDistinct("foto_id").alias("fotos_listas"),
        F.count("duplicado_de").alias("duplicados"),
    )
    record = F.struct(
        "id", "foto_id", "titulo", "autor", "titulo_raw", "autor_raw", "confianza", "estado"
    )
    listed = json_pages(
        new_books(books).filter(F.col("lote_id").isNotNull()),
        ["lote_id"],
        ["confianza", "id"],
        record,
        page_size,
    ).withColumnsRenamed({"lote_id": "id", "n": "cant_libros", "documento": "libros"})
    joined = materialise(batches.select("id", "estado", "cant_fotos").join(progress, "id", "left"))
    return (
        joined.join(listed, "id", "left")
        .fillna(
            {"fotos_listas": 0, "duplicados": 0, "cant_libros": 0, "pagina": 0, "paginas": 1, "libros": "[]"}
        )
    )


def photo_owners(photos: DataFrame, batches: DataFrame) -> DataFrame:
    """Each photo with the shop of its batch."""
    owner = batches.select(F.col("id").alias("lote_id"), "libreria_id")
    return photos.join(owner, "lote_id").select("id", "lote_id", "libreria_id", "path", "orden")


def owned(requests: DataFrame, things: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (id, libreria_id) requests into those that hit a row of that shop and the rest."""
    keys = things.select("id", "libreria_id")
    return (
        requests.join(keys, ["id", "libreria_id"], "left_semi"),
        requests.join(keys, ["id", "libreria_id"], "left_anti"),
    )


def not_found_links(shops: DataFrame, searches: DataFrame) -> DataFrame:
    """Generic consultation link of each search (consulta_id, libreria_id, q, resultados) that found nothing."""
    info = active(shops).select(F.col("id").alias("libreria_id"), "whatsapp")
    rows = searches.filter(F.col("resultados") == 0).join(info, "libreria_id")
    said = text.not_found_message("q")
    return rows.select(
        "consulta_id",
        "libreria_id",
        said.alias("mensaje"),
        text.whatsapp_link("whatsapp", said).alias("enlace"),
    )


def photos_in_order(photos: DataFrame) -> DataFrame:
    """Photos of each batch with their place in the review; a batch has at most ten."""
    order = Window.partitionBy("lote_id").orderBy("orden", "id")
    return photos.select("id", "lote_id", "path", "orden", F.row_number().over(order).alias("puesto"))


def consult_links(
    shops: DataFrame, books: DataFrame, base: str = "https://example.org"
) -> DataFrame:
    """Chat link of each published book and the QR target of its shop."""
    info = active(shops).select(
        F.col("id").alias("libreria_id"), "slug", "whatsapp", "mensaje_wa_template"
    )
    rows = public_books(books).join(info, "libreria_id")
    filled = text.message("mensaje_wa_template", "titulo", "autor")
    return rows.select(
        "id",
        F.coalesce(F.nullif("autor", F.lit("")), F.lit(schemas.NO_AUTHOR)).alias("autor_visible"),
        filled.alias("mensaje"),
        text.whatsapp_link("whatsapp", filled).alias("enlace"),
        text.qr_target(base, "slug").alias("qr"),
        text.day_month("creado_en").alias("visto_el"),
    )
