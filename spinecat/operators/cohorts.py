"""Weekly cohorts, retention and the learning metrics per shop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat.operators.catalog import was_corrected
from spinecat.operators.joins import join_unique
from spinecat.operators.lifecycle import split_edits
from spinecat.operators.metrics import flagged
from spinecat.operators.pages import ranged

# Thresholds of the learning metrics.
MAX_EDITED = 0.20
MIN_CLICK_SESSIONS = 0.05
MIN_MEDIAN_SEARCHES = 1
FIRST_BATCH_HOURS = 72
BOUNCE_SECONDS = 20
ATTRIBUTION_DAYS = 21


def week_of(col: str) -> Column:
    return F.date_trunc("week", F.col(col)).alias("semana")


def spine(shops: DataFrame, *activity: DataFrame) -> DataFrame:
    """Every week of every shop, from its sign-up or first activity to the last week of any input.

    ``activity`` are tables of one row per libreria_id and semana. Shops that only they know
    have a spine too.
    """
    firsts = shops.select(F.col("id").alias("libreria_id"), week_of("creado_en"))
    for rows in activity:
        firsts = firsts.unionByName(rows.select("libreria_id", "semana"))
    last = firsts.agg(F.max("semana")).scalar()
    weeks = F.sequence(F.col("primera"), last, F.expr("INTERVAL 7 DAYS"))
    per_shop = firsts.groupBy("libreria_id").agg(F.min("semana").alias("primera"))
    return per_shop.select("libreria_id", F.explode(weeks).alias("semana"))


def weekly_activity(events: DataFrame) -> DataFrame:
    tipo = F.col("tipo")
    return flagged(events).groupBy("libreria_id", week_of("creado_en")).agg(
        F.count_if(tipo == "lote_publicado").alias("lotes_publicados"),
        F.coalesce(F.sum("publicados"), F.lit(0)).alias("libros_publicados"),
        F.count_if(tipo == "vista").alias("vistas"),
        F.count_if(tipo == "busqueda").alias("busquedas"),
        F.count_if(tipo == "clic_whatsapp").alias("clics"),
    )


def weekly_corrections(books: DataFrame) -> DataFrame:
    """Books read per week and how many differ from the model's own reading.

    Stored rows cannot tell a correction by the model from one by the shop; this is the
    share of both. ``weekly_shop_edits`` gives the shop's own where a decision log is kept.
    """
    return books.groupBy("libreria_id", week_of("creado_en")).agg(
        F.count("*").alias("libros_leidos"), F.count_if(was_corrected()).alias("corregidos")
    )


def weekly_shop_edits(books: DataFrame, edits: DataFrame) -> DataFrame:
    """Books per week of reading that the shop itself gave another title or author.

    Rejected edits change nothing and do not count.
    """
    before = books.select(
        F.col("id").alias("libro_id"), F.col("titulo").alias("t0"), F.col("autor").alias("a0")
    )
    valid, _ = split_edits(edits)
    touched = (
        valid.join(before, "libro_id")
        .filter(
            (F.trim("titulo") != F.trim("t0"))
            | (F.trim(F.coalesce("autor", F.lit(""))) != F.trim("a0"))
        )
        .select(F.col("libro_id").alias("id"))
        .distinct()
        .withColumn("editado", F.lit(True))
    )
    return books.join(touched, "id", "left").groupBy("libreria_id", week_of("creado_en")).agg(
        F.count("*").alias("libros_leidos"), F.count("editado").alias("editados")
    )


def weekly_cohort(shops: DataFrame, books: DataFrame, events: DataFrame) -> DataFrame:
    """The cohort table: one row per shop and week, quiet weeks included."""
    counts = [
        "lotes_publicados", "libros_publicados", "vistas", "busquedas", "clics",
        "libros_leidos", "corregidos",
    ]
    keys = ["libreria_id", "semana"]
    active, read = weekly_activity(events), weekly_corrections(books)
    table = (
        spine(shops, active, read)
        .join(active, keys, "left")
        .join(read, keys, "left")
        .fillna(0, counts)
    )
    return table.withColumn(
        "parte_corregida",
        F.when(F.col("libros_leidos") > 0, F.col("corregidos") / F.col("libros_leidos")),
    )


def sessions(events: DataFrame) -> DataFrame:
    """One row per browser session of a shop."""
    tipo = F.col("tipo")
    rows = flagged(events).filter(F.coalesce("session_id", F.lit("")) != "")
    return rows.groupBy("libreria_id", "session_id").agg(
        F.min("creado_en").alias("inicio"),
        F.max("creado_en").alias("fin"),
        F.count_if(tipo == "busqueda").alias("busquedas"),
        F.count_if(tipo == "clic_whatsapp").alias("clics"),
    )


def innovation_metrics(books: DataFrame, events: DataFrame) -> DataFrame:
    """Learning metrics of each shop and week with their thresholds."""
    keys = ["libreria_id", "semana"]
    per_session = sessions(events).groupBy("libreria_id", week_of("inicio")).agg(
        F.count("*").alias("sesiones"),
        F.median("busquedas").alias("mediana_busquedas"),
        F.count_if(F.col("clics") > 0).alias("sesiones_con_clic"),
    )
    qr = flagged(events).groupBy("libreria_id", week_of("creado_en")).agg(
        F.count_if("es_qr").alias("escaneos_qr")
    )
    joined = weekly_corrections(books).join(per_session, keys, "full").join(qr, keys, "full")
    share = F.when(F.col("libros_leidos") > 0, F.col("corregidos") / F.col("libros_leidos"))
    clicks = F.when(F.col("sesiones") > 0, F.col("sesiones_con_clic") / F.col("sesiones"))
    return joined.select(
        *keys,
        share.alias("parte_corregida"),
        F.coalesce("escaneos_qr", F.lit(0)).alias("escaneos_qr"),
        "mediana_busquedas",
        clicks.alias("parte_clic"),
        (share < MAX_EDITED).alias("correccion_bien"),
        (F.coalesce("escaneos_qr", F.lit(0)) > 0).alias("qr_bien"),
        (F.col("mediana_busquedas") >= MIN_MEDIAN_SEARCHES).alias("busqueda_bien"),
        (clicks >= MIN_CLICK_SESSIONS).alias("clic_bien"),
    )


def bounce_share(events: DataFrame) -> DataFrame:
    """Share of sessions without search or click that last under twenty seconds."""
    length = F.unix_micros("fin") - F.unix_micros("inicio")
    bounced = (
        (F.col("busquedas") == 0)
        & (F.col("clics") == 0)
        & (length < BOUNCE_SECONDS * 1_000_000)
    )
    return (
        sessions(events)
        .groupBy("libreria_id")
        .agg(F.count("*").alias("sesiones"), F.count_if(bounced).alias("rebotes"))
        .withColumn("parte_rebote", F.col("rebotes") / F.col("sesiones"))
    )


def demand_gap_share(events: DataFrame) -> DataFrame:
    """Share of searches without result of each shop."""
    rows = flagged(events).filter(F.col("tipo") == "busqueda")
    counted = rows.groupBy("libreria_id").agg(
        F.count("*").alias("busquedas"), F.count_if("sin_resultado").alias("sin_resultado")
    )
    return counted.withColumn("brecha", F.col("sin_resultado") / F.col("busquedas"))


def batch_gaps(batches: DataFrame) -> DataFrame:
    """Hours from each batch to the next one of its shop.

    The batches are range-partitioned by shop and time over the whole cluster. The successor is
    looked up inside a range; only the last batch of a shop in its range asks for the shop's first
    one in a later range, from one row per shop and range. So no task sorts all batches of a shop,
    also when an import brings a whole catalogue in one day.
    """
    fixed = ranged(batches.select("id", "libreria_id", "creado_en"), ["libreria_id"], ["creado_en", "id"])
    keys = ["libreria_id", "tramo"]
    inside = fixed.withColumn("sigue", F.lead("creado_en").over(Window.partitionBy(*keys).orderBy("creado_en", "id")))
    ranges = fixed.groupBy(*keys).agg(F.min("creado_en").alias("primero"))
    later = Window.partitionBy("libreria_id").orderBy("tramo")
    follow = ranges.select(*keys, F.lead("primero").over(later).alias("otro"))
    joined = join_unique(inside, follow, keys)
    hours = (F.unix_seconds(F.coalesce("sigue", "otro")) - F.unix_seconds("creado_en")) / 3600
    return joined.select("id", "libreria_id", "creado_en", hours.alias("horas_al_siguiente"))


def batch_cadence(shops: DataFrame, batches: DataFrame) -> DataFrame:
    """Sign-up to first batch in hours, whether in time, and whether a second one came."""
    per_shop = batches.groupBy(F.col("libreria_id").alias("id")).agg(
        F.min("creado_en").alias("primero"), F.count("*").alias("lotes")
    )
    joined = shops.join(per_shop, "id", "left")
    hours = (F.unix_seconds("primero") - F.unix_seconds("creado_en")) / 3600
    return joined.select(
        F.col("id").alias("libreria_id"),
        hours.alias("horas_primer_lote"),
        F.coalesce(hours <= FIRST_BATCH_HOURS, F.lit(False)).alias("a_tiempo"),
        F.coalesce("lotes", F.lit(0)).alias("lotes"),
        (F.coalesce("lotes", F.lit(0)) >= 2).alias("segunda_tanda"),
    )


def retention(shops: DataFrame, batches: DataFrame, events: DataFrame) -> DataFrame:
    """Batches and events of each shop by week since sign-up (1 is the first; 0 and less: before).

    One row for every week with activity, however many there are.
    """
    signed = shops.select(F.col("id").alias("libreria_id"), F.col("creado_en").alias("alta"))

    def weekly(df: DataFrame, name: str) -> DataFrame:
        daily = df.groupBy("libreria_id", F.to_date("creado_en").alias("dia")).agg(
            F.count("*").alias("n")
        )
        week = F.floor(F.date_diff("dia", F.to_date("alta")) / 7) + 1
        return (
            daily.join(signed, "libreria_id")
            .groupBy("libreria_id", week.alias("semana"))
            .agg(F.sum("n").alias(name))
        )

    keys = ["libreria_id", "semana"]
    both = weekly(batches, "lotes").join(weekly(events, "eventos"), keys, "full")
    return both.fillna(0, ["lotes", "eventos"])


def retention_flags(shops: DataFrame, batches: DataFrame, events: DataFrame) -> DataFrame:
    """Active weeks of each shop, week-4 retention and batches in weeks 2 and 3."""
    week, brought = F.col("semana"), F.col("lotes") > 0
    flags = retention(shops, batches, events).groupBy("libreria_id").agg(
        F.count_if(week >= 1).alias("semanas_activas"),
        F.max(week).alias("ultima_semana"),
        F.max(week == 4).alias("retiene_4"),
        F.max((week == 2) & brought).alias("lote_semana_2"),
        F.max((week == 3) & brought).alias("lote_semana_3"),
    )
    named = shops.select(F.col("id").alias("libreria_id")).join(flags, "libreria_id", "left")
    return named.fillna(0, ["semanas_activas"]).fillna(
        False, ["retiene_4", "lote_semana_2", "lote_semana_3"]
    )


def cycles(books: DataFrame) -> DataFrame:
    """Inventory cycles of each shop, each compared with the one before.

    Books are counted per archive stamp first; the ranking window sees one row per cycle.
    """
    per_cycle = books.groupBy("libreria_id", "archivado_en").agg(
        F.count("*").alias("libros"),
        F.count_if(F.col("estado") == "publicado").alias("publicados"),
        F.count_if(F.col("estado") == "vendido").alias("vendidos"),
    )
    order = Window.partitionBy("libreria_id").orderBy(F.asc_nulls_last("archivado_en"))
    return per_cycle.select(
        "libreria_id",
        F.dense_rank().over(order).alias("ciclo"),
        F.col("archivado_en").isNull().alias("abierto"),
        "libros",
        "publicados",
        "vendidos",
        (F.col("libros") - F.lag("libros").over(order)).alias("cambio_libros"),
    )


def no_click_shops(shops: DataFrame, events: DataFrame) -> DataFrame:
    """Clicks of each shop in its first three weeks; none means no consultation came."""
    first = shops.select(F.col("id").alias("libreria_id"), F.col("creado_en").alias("alta"))
    window_end = F.col("alta") + F.expr(f"INTERVAL {ATTRIBUTION_DAYS} DAYS")
    early = (
        events.filter(F.col("tipo") == "clic_whatsapp")
        .join(first, "libreria_id")
        .filter((F.col("creado_en") >= F.col("alta")) & (F.col("creado_en") < window_end))
        .groupBy("libreria_id")
        .agg(F.count("*").alias("clics"))
    )
    joined = first.select("libreria_id").join(early, "libreria_id", "left").fillna(0, ["clics"])
    return joined.withColumn("sin_consultas", F.col("clics") == 0)


def shop_signal(shops: DataFrame, batches: DataFrame, events: DataFrame) -> DataFrame:
    """What the recorded activity suggests for each shop.

    The two outcomes that need interview answers are not decided here.
    """
    counts = batches.groupBy(F.col("libreria_id").alias("id")).agg(F.count("*").alias("lotes"))
    traffic = events.groupBy(F.col("libreria_id").alias("id")).agg(
        F.count_if(F.col("tipo") == "clic_whatsapp").alias("clics"),
        F.count_if(F.col("tipo") == "busqueda").alias("busquedas"),
    )
    joined = (
        shops.select("id")
        .join(counts, "id", "left")
        .join(traffic, "id", "left")
        .fillna(0, ["lotes", "clics", "busquedas"])
    )
    signal = (
        F.when(F.col("lotes") == 0, "sin_lotes")
        .when(F.col("lotes") < 2, "pivot_de_canal")
        .when((F.col("clics") == 0) & (F.col("busquedas") == 0), "pivot_de_segmento")
        .when(F.col("clics") == 0, "sin_consultas")
        .otherwise("perseverar")
    )
    return joined.select(
        F.col("id").alias("libreria_id"), "lotes", "clics", "busquedas", signal.alias("senal")
    )
