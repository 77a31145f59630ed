"""Per-shop metrics over the event log, for all shops in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import payload as P
from spinecat.functions import text


def flagged(events: DataFrame) -> DataFrame:
    """Decode each payload once and keep what the reports ask for."""
    decoded = events.withColumn("p", P.decode("payload"))
    tipo = F.col("tipo")
    return decoded.select(
        "id",
        "libreria_id",
        "tipo",
        "session_id",
        "creado_en",
        ((tipo == "vista") & P.equals(F.col("p"), "src", "qr")).alias("es_qr"),
        ((tipo == "busqueda") & P.zero(F.col("p"), "resultados")).alias("sin_resultado"),
        ((tipo == "clic_whatsapp") & P.truthy(F.col("p"), "generico")).alias("generico"),
        F.when(tipo == "busqueda", text.term_key(P.text(F.col("p"), "q"))).alias("termino"),
        F.when(
            (tipo == "clic_whatsapp") & P.truthy(F.col("p"), "titulo"), P.shown(F.col("p"), "titulo")
        ).alias("titulo"),
        F.when(tipo == "lote_publicado", P.shown(F.col("p"), "publicados"))
        .try_cast("long")
        .alias("publicados"),
    )


def event_metrics(events: DataFrame) -> DataFrame:
    """Views, searches, clicks and sessions of each shop."""
    tipo = F.col("tipo")
    grouped = flagged(events).groupBy("libreria_id")
    counted = grouped.agg(
        F.count_if(tipo == "vista").alias("vistas_total"),
        F.count_if("es_qr").alias("vistas_qr"),
        F.count_if(tipo == "busqueda").alias("busquedas_total"),
        F.count_if("sin_resultado").alias("busquedas_sin_resultado"),
        F.count_if(tipo == "clic_whatsapp").alias("clics_total"),
        F.count_if("generico").alias("clics_genericos"),
        F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sesiones_unicas"),
    )
    return counted.withColumns(
        {
            "vistas_link": F.col("vistas_total") - F.col("vistas_qr"),
            "clics_por_libro": F.col("clics_total") - F.col("clics_genericos"),
        }
    )


def inventory_summary(books: DataFrame) -> DataFrame:
    live = F.col("archivado_en").isNull()
    estado = F.col("estado")
    return books.groupBy("libreria_id").agg(
        F.count_if(live & (estado == "publicado")).alias("publicados"),
        F.count_if(live & (estado == "vendido")).alias("vendidos"),
        F.count_if(live & (estado == "pendiente")).alias("pendientes"),
        F.count("duplicado_de").alias("duplicados_detectados"),
        F.count("archivado_en").alias("archivados"),
    )


def batch_summary(batches: DataFrame) -> DataFrame:
    return batches.groupBy("libreria_id").agg(
        F.count("*").alias("lotes_total"),
        F.count_if(F.col("estado") == "publicado").alias("lotes_publicados"),
        F.count("archivado_en").alias("lotes_archivados"),
    )


def shop_dashboard(
    shops: DataFrame, books: DataFrame, batches: DataFrame, events: DataFrame
) -> DataFrame:
    """One row per shop with every counter of its metrics page; shops without rows get zeros."""
    result = shops.select(F.col("id").alias("libreria_id"), "slug", "nombre")
    for part in (inventory_summary(books), batch_summary(batches), event_metrics(events)):
        result = result.join(part, "libreria_id", "left")
    return result.fillna(0)


def _top(counted: DataFrame, label: str, k: int) -> DataFrame:
    """First k labels of each shop; ties go to the label seen most recently."""
    order = Window.partitionBy("libreria_id").orderBy(
        F.desc("n"), F.desc("visto_en"), F.desc("visto_id")
    )
    ranked = counted.withColumn("puesto", F.row_number().over(order)).filter(
        F.col("puesto") <= k
    )
    return ranked.select("libreria_id", "puesto", label, "n")


def _count_labels(rows: DataFrame, label: str) -> DataFrame:
    """Occurrences and the latest sighting (time, then id) of each label of a shop."""
    by_time = rows.groupBy("libreria_id", label, "creado_en").agg(
        F.count("*").alias("m"), F.max("id").alias("ultimo")
    )
    return by_time.groupBy("libreria_id", label).agg(
        F.sum("m").alias("n"),
        F.max("creado_en").alias("visto_en"),
        F.max_by("ultimo", "creado_en").alias("visto_id"),
    )


def top_zero_result_terms(events: DataFrame, k: int = schemas.TOP_TERMS) -> DataFrame:
    rows = flagged(events).filter(F.col("sin_resultado") & (F.col("termino") != ""))
    return _top(_count_labels(rows, "termino"), "termino", k)


def top_consulted_titles(events: DataFrame, k: int = schemas.TOP_TERMS) -> DataFrame:
    named = F.coalesce(F.nullif("titulo", F.lit("")), F.lit(schemas.NO_TITLE))
    rows = (
        flagged(events)
        .filter((F.col("tipo") == "clic_whatsapp") & ~F.col("generico"))
        .withColumn("titulo", named)
    )
    return _top(_count_labels(rows, "titulo"), "titulo", k)


def describe(tipo: Column, p: Column) -> Column:
    """One display line per event."""

    def plural(name: str) -> Column:
        # The number one and true, but not the text "1".
        return F.when(P.field(p, name).rlike(r"^(true|1(\.0*)?)$"), F.lit("")).otherwise(F.lit("s"))

    src, title = P.shown(p, "src"), P.shown(p, "titulo")
    return (
        F.when(
            tipo == "vista",
            F.concat(
                F.lit("👀 Vista"),
                F.when(P.truthy(p, "src"), F.concat(F.lit(" ("), src, F.lit(")"))).otherwise(
                    F.lit("")
                ),
            ),
        )
        .when(
            tipo == "busqueda",
            F.concat(
                F.lit('🔎 Búsqueda: "'),
                P.shown(p, "q"),
                F.lit('" — '),
                P.shown(p, "resultados"),
                F.lit(" resultado"),
                plural("resultados"),
            ),
        )
        .when(
            tipo == "clic_whatsapp",
            F.concat(
                F.lit("💬 WhatsApp"),
                F.when(P.truthy(p, "generico"), F.lit(" (genérico)"))
                .when(P.truthy(p, "titulo"), F.concat(F.lit(": "), title))
                .otherwise(F.lit("")),
            ),
        )
        .when(
            tipo == "inventario_reiniciado",
            F.concat(
                F.lit("🧹 Inventario reiniciado ("),
                P.shown(p, "libros_archivados"),
                F.lit(" libros)"),
            ),
        )
        .when(
            tipo == "lote_publicado",
            F.concat(
                F.lit("📚 Lote publicado ("),
                P.shown(p, "publicados"),
                F.lit(" libro"),
                plural("publicados"),
                F.lit(")"),
            ),
        )
        .otherwise(tipo)
    )


def recent_events(events: DataFrame, n: int = schemas.RECENT_EVENTS) -> DataFrame:
    """Latest n events of each shop with their display line.

    The rank filter is applied inside each input partition before the shuffle, so a shop
    with most of the log sends at most n rows per task.
    """
    newest = Window.partitionBy("libreria_id").orderBy(F.desc("creado_en"), F.desc("id"))
    ranked = events.withColumn("puesto", F.row_number().over(newest)).filter(
        F.col("puesto") <= n
    )
    shown = ranked.withColumn("p", P.decode("payload"))
    return shown.select(
        "libreria_id",
        "puesto",
        "id",
        describe(F.col("tipo"), F.col("p")).alias("linea"),
        F.date_format("creado_en", "dd/MM HH:mm").alias("cuando"),
    )


def demand_gap(events: DataFrame) -> DataFrame:
    """Share of searches without result, by shop and term."""
    rows = flagged(events).filter((F.col("tipo") == "busqueda") & (F.col("termino") != ""))
    counted = rows.groupBy("libreria_id", "termino").agg(
        F.count("*").alias("busquedas"), F.count_if("sin_resultado").alias("sin_resultado")
    )
    return counted.withColumn("brecha", F.col("sin_resultado") / F.col("busquedas"))
