"""What enters the tables: shops, upload batches, events. Bad rows come back with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import text
from spinecat.operators.joins import join_unique


def register_shops(existing: DataFrame, new: DataFrame, now: Column | None = None):
    """(accepted shops, rejected requests) for sign-ups in order of ``solicitud``.

    Needs solicitud, nombre, whatsapp, slug, mensaje_wa_template. A slug belongs to whoever
    has it already, else to the first valid request.
    """
    phone = text.strip(text.or_empty("whatsapp"))
    template = text.strip(text.or_empty("mensaje_wa_template"))
    clean = new.select(
        "solicitud",
        text.strip(text.or_empty("nombre")).alias("nombre"),
        phone.alias("whatsapp"),
        text.slug(F.coalesce(F.nullif("slug", F.lit("")), F.col("nombre"))).alias("slug"),
        F.coalesce(F.nullif(template, F.lit("")), F.lit(schemas.DEFAULT_TEMPLATE)).alias(
            "mensaje_wa_template"
        ),
        phone.rlike("^[0-9]{10,15}$").alias("telefono_bien"),
    )
    firsts = (
        clean.filter("telefono_bien")
        .groupBy("slug")
        .agg(F.min("solicitud").alias("primera"))
    )
    taken = existing.select("slug").distinct().withColumn("ocupado", F.lit(True))
    decided = (
        join_unique(join_unique(clean, firsts, ["slug"]), taken, ["slug"])
        .withColumn(
            "motivo",
            F.when(~F.col("telefono_bien"), "whatsapp").when(
                F.col("ocupado") | (F.col("solicitud") != F.col("primera")), "slug"
            ),
        )
    )
    columns = ["solicitud", "slug", "nombre", "whatsapp", "mensaje_wa_template"]
    accepted = decided.filter(F.col("motivo").isNull()).select(
        *columns,
        (F.current_timestamp() if now is None else now).alias("creado_en"),
        F.lit(True).alias("activa"),
    )
    return accepted, decided.filter(F.col("motivo").isNotNull()).select(*columns, "motivo")


def make_batches(files: DataFrame, now: Column | None = None):
    """(batches, photos, rejected batches) from uploaded files.

    Needs lote_id, libreria_id, subida (upload order) and path. Sizes are counted first, so
    the ordering window only ever sees batches of at most ten photos.
    """
    at = F.current_timestamp() if now is None else now
    sizes = files.groupBy("lote_id", "libreria_id").agg(F.count("path").alias("cant_fotos"))
    fits = F.col("cant_fotos").between(1, schemas.MAX_PHOTOS)
    batches = sizes.filter(fits).select(
        F.col("lote_id").alias("id"),
        "libreria_id",
        F.lit("procesando").alias("estado"),
        "cant_fotos",
        at.alias("creado_en"),
    )
    rejected = sizes.filter(~fits).withColumn("motivo", F.lit("cantidad"))
    in_order = Window.partitionBy("lote_id").orderBy("subida")
    photos = (
        files.join(batches.select(F.col("id").alias("lote_id")), "lote_id", "left_semi")
        .withColumn("orden", F.row_number().over(in_order) - 1)
        .select("lote_id", "orden", "path")
    )
    return batches, photos, rejected


def _resolved(raw: DataFrame, shops: DataFrame) -> DataFrame:
    """Raw events with the id of their active shop and a reason when they must be refused."""
    known = shops.filter("activa").select("slug", F.col("id").alias("libreria_id"))
    joined = raw.join(known, "slug", "left")
    return joined.withColumn(
        "motivo",
        F.when(F.col("libreria_id").isNull(), "slug").when(
            ~F.coalesce(F.col("tipo").isin(schemas.PUBLIC_EVENTS), F.lit(False)), "tipo"
        ),
    )


def accepted_events(marked: DataFrame, now: Column | None = None) -> DataFrame:
    stored = {"slug", "motivo", "libreria_id", "tipo", "payload", "session_id", "creado_en"}
    extra = [c for c in marked.columns if c not in stored]
    return marked.filter(F.col("motivo").isNull()).select(
        *extra,
        "libreria_id",
        "tipo",
        F.coalesce("payload", F.lit("{}")).alias("payload"),
        F.nullif("session_id", F.lit("")).alias("session_id"),
        (F.current_timestamp() if now is None else now).alias("creado_en"),
    )


def refused_events(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("motivo").isNotNull()).drop("libreria_id")


def ingest(
    raw: DataFrame, shops: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows for the event log, refused rows with a reason); works on streams too."""
    marked = _resolved(raw, shops)
    return accepted_events(marked, now), refused_events(marked)


def check_states(df: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows by the state list of their table."""
    good = F.coalesce(F.col("estado").isin(allowed), F.lit(False))
    return df.filter(good), df.filter(~good).withColumn("motivo", F.lit("estado"))
