"""Extraction quality: labelled evaluation, image study, call economics, exact copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat.functions import text
from spinecat.operators.joins import join_unique
from spinecat.session import materialise

# Bands of the books-per-photo and dropped-author study.
BOOK_BANDS = [(5, 13), (14, 19), (20, 28)]
HIGH_SHARE = 0.2
LOW_SHARE = 0.1


def _title_fits(e: Column, d: Column) -> Column:
    return (d["t"] != "") & (
        text.contained(e["t"], d["t"]) | text.enough_overlap(e["w"], d["w"])
    )


def _author_fits(e: Column, d: Column) -> Column:
    return (d["a"] != "") & (
        text.contained(e["a"], d["a"])
        | (text.common_words(text.tokens(e["a"]), text.tokens(d["a"])) >= 1)
    )


def _keyed(books: Column, title: str, author: str, *more: str) -> Column:
    """Books of an array with their keys: pos, t, w (words of t), a and the named members."""
    keys = F.transform(
        books,
        lambda b, i: F.struct(
            i.alias("i"), text.key(b[title]).alias("t"), text.key(b[author]).alias("a"), b.alias("b")
        ),
    )
    return F.transform(
        keys,
        lambda k: F.struct(
            k["i"].alias("i"), k["t"].alias("t"), text.tokens(k["t"]).alias("w"), k["a"].alias("a"),
            *[k["b"][m].alias(m) for m in more],
        ),
    )


def side_by_side(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Detected books (d) next to the expected books (e) of their photo, one row per answer.

    ``answers`` are ``responses.books``, ``truth`` is ``files.truth_photos``. Both sides bring
    their books as one array out of one JSON document; one join by photo brings them together,
    and nothing is exploded or collected. Two answers to a photo are two rows. Each side is written
    once parsed, so what made it takes no room any more when they meet, and keys are made after that.
    """
    listed = F.transform("libros", lambda b: F.struct(b["pos"].alias("pos"), b["titulo"].alias("titulo"), b["autor"].alias("autor")))
    detected = materialise(answers.withColumns({"foto": F.col("foto_id").cast("string"), "libros": listed}))
    visible = "autor_visible_en_foto"
    wanted = F.transform("esperados", lambda b: F.struct(b["titulo"].alias("titulo"), b["autor"].alias("autor"), b[visible].alias(visible)))
    expected = materialise(truth.select("foto", wanted.alias("esperados")))
    both = detected.join(expected, "foto")
    both = both.withColumn("d", _keyed(F.col("libros"), "titulo", "autor", "pos"))
    return both.withColumn("e", _keyed(F.col("esperados"), "titulo", "autor", visible)).drop("libros", "esperados")


def title_match_pairs(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Every expected and detected title of a photo that fit together."""
    sides = side_by_side(answers, truth).select("modelo", "foto", "d", F.explode("e").alias("e1"))
    fits = sides.select(
        "modelo",
        "foto",
        "e1",
        F.explode(F.filter("d", lambda d: _title_fits(F.col("e1"), d))).alias("d1"),
    )
    return fits.select(
        "modelo",
        "foto",
        F.col("e1.i").alias("pos_esperado"),
        F.col("d1.pos").alias("pos_detectado"),
        text.common_words(F.col("e1.w"), F.col("d1.w")).alias("comunes"),
    )


def assigned(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``elegido``: for each expected book the first free detected book that fits, or -1."""

    def pick(taken: Column, e: Column) -> Column:
        free = F.filter(
            F.col("d"), lambda d: ~F.array_contains(taken, d["pos"]) & _title_fits(e, d)
        )
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0))["pos"], F.lit(-1))))

    return side_by_side(answers, truth).withColumn(
        "elegido", F.aggregate("e", F.array().cast("array<int>"), pick)
    )


def scores(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Titles and authors right, authors made up, cost and latency of each model.

    Every answer is scored on its own; a failed one counts with its expected titles, no books
    and no cost.
    """
    rows = assigned(answers, truth)
    ok = F.col("motivo").isNull()
    pairs = F.transform(
        "e",
        lambda e, i: F.struct(
            e.alias("e"),
            F.get(
                F.filter("d", lambda d: d["pos"] == F.get("elegido", i)), F.lit(0)
            ).alias("d"),
        ),
    )
    hits = rows.withColumn("p", F.filter(pairs, lambda p: p["d"].isNotNull()))

    def count(condition) -> Column:
        return F.size(F.filter("p", condition))

    per_answer = hits.select(
        "modelo",
        "latencia_ms",
        ok.alias("ok"),
        F.when(ok, F.col("costo")).otherwise(F.lit(0.0)).alias("costo"),
        F.size("e").alias("titulos"),
        F.size("d").alias("libros"),
        F.size("p").alias("titulos_ok"),
        count(lambda p: p["e"]["autor_visible_en_foto"]).alias("autores"),
        count(lambda p: p["e"]["autor_visible_en_foto"] & _author_fits(p["e"], p["d"])).alias("autores_ok"),
        count(lambda p: ~p["e"]["autor_visible_en_foto"] & (p["d"]["a"] != "")).alias("inventados"),
    )
    return per_answer.groupBy("modelo").agg(
        F.sum("titulos_ok").alias("titulos_ok"),
        F.sum("titulos").alias("titulos_total"),
        F.sum("autores_ok").alias("autores_ok"),
        F.sum("autores").alias("autores_total"),
        F.sum("inventados").alias("autores_inventados"),
        F.sum("libros").alias("libros_devueltos"),
        F.count_if(~F.col("ok")).alias("fotos_fallidas"),
        F.round(F.sum("costo"), 6).alias("costo"),
        F.bround(F.sum("latencia_ms") / F.count("*"), 0).cast("long").alias("latencia_media"),
    )


def image_metrics(answers: DataFrame) -> DataFrame:
    """Books, mean confidence and dropped authors of each answer; summed in book order.

    A failed answer keeps its row, with ``ok`` false, no books and no cost.
    """
    ok = F.col("motivo").isNull()
    count = F.size("libros")
    total = F.aggregate("libros", F.lit(0.0), lambda s, b: s + F.coalesce(b["confianza"], F.lit(0.0)))
    return answers.select(
        "modelo",
        "foto_id",
        ok.alias("ok"),
        count.alias("cant_libros"),
        text.round_share(total / F.greatest(count, F.lit(1))).alias("confianza_media"),
        F.size(F.filter("libros", lambda b: b["autor_descartado"].isNotNull())).alias("guardrail_disparado"),
        F.when(ok, F.col("costo")).otherwise(F.lit(0.0)).alias("costo"),
        "latencia_ms",
    )


def total_cost(results: DataFrame) -> DataFrame:
    return results.agg(F.round(F.sum("costo"), 6).alias("costo_total"))


def guard_crosstab(
    results: DataFrame, bands: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Photos with a high, middle or low share of dropped authors, by books per photo.

    What lies outside the bands has a band of its own (``<5``, ``>28``), and so has a gap between
    two, so every photo counts once.
    """
    chosen = BOOK_BANDS if bands is None else bands
    count = F.col("cant_libros")
    label = F.lit(f">{chosen[-1][1]}")
    for k in range(len(chosen) - 1, -1, -1):
        low, high = chosen[k]
        label = F.when(count <= high, f"{low}-{high}").otherwise(label)
        below = f"{chosen[k - 1][1] + 1}-{low - 1}" if k else f"<{low}"
        label = F.when(count < low, below).otherwise(label)
    share = F.col("guardrail_disparado") / F.greatest(count, F.lit(1))
    high, low = F.col("cuota") > HIGH_SHARE, F.col("cuota") <= LOW_SHARE
    return results.withColumns({"banda": label, "cuota": share}).groupBy("banda").agg(
        F.count("*").alias("fotos"),
        F.count_if(high).alias("alto"),
        F.count_if(~high & ~low).alias("medio"),
        F.count_if(low).alias("bajo"),
    )


def variants(results: DataFrame) -> DataFrame:
    """Photo and variant of each result from ``name [variant]``; no brackets is the original.

    Long form: one row per result and whatever variant it names; pivot it for display.
    """
    parts = r"^(.*) \[([^\]]*)\]$"
    tail = F.regexp_extract("etiqueta", parts, 2)
    return results.withColumns(
        {
            "variante": F.when(tail == "", F.lit("original")).otherwise(tail),
            "foto": F.when(tail == "", F.col("etiqueta")).otherwise(
                F.regexp_extract("etiqueta", parts, 1)
            ),
        }
    )


def call_economics(calls: DataFrame) -> DataFrame:
    """Calls, retries, failures, latency, tokens and cost of each model."""
    rows = calls.filter(F.col("clase").isin("vision_ok", "vision_fallo"))
    ok = F.col("clase") == "vision_ok"
    return rows.groupBy("modelo").agg(
        F.count("*").alias("llamadas"),
        F.count_if(F.col("intento") > 1).alias("reintentos"),
        F.count_if(~ok).alias("fallos"),
        (F.count_if(~ok) / F.count("*")).alias("tasa_fallo"),
        (F.sum("latencia_ms") / F.count("*")).alias("latencia_media"),
        F.max("latencia_ms").alias("latencia_max"),
        F.sum("tokens_entrada").alias("tokens_entrada"),
        F.sum("tokens_salida").alias("tokens_salida"),
        F.round(F.sum("costo"), 6).alias("costo"),
    )


def latency_percentiles(calls: DataFrame) -> DataFrame:
    """Median and 95th percentile latency of each model (histogram by value)."""
    rows = calls.filter(F.col("clase").isin("vision_ok", "vision_fallo"))
    return rows.groupBy("modelo").agg(
        F.percentile_approx("latencia_ms", 0.5, 100_000).alias("p50"),
        F.percentile_approx("latencia_ms", 0.95, 100_000).alias("p95"),
    )


def batch_costs(calls: DataFrame) -> DataFrame:
    """Cost of model calls per processed batch, over the whole log."""
    return calls.agg(
        F.count_if(F.col("clase") == "lote_procesado").alias("lotes"),
        F.sum("nuevos").alias("nuevos"),
        F.sum("duplicados").alias("duplicados"),
        F.round(
            F.sum("costo") / F.count_if(F.col("clase") == "lote_procesado"), 6
        ).alias("costo_por_lote"),
    )


def mark_copies(files: DataFrame, name: str, digest: str) -> DataFrame:
    """Each file with the kept copy of its content: the first by name.

    The keeper is found by aggregation, and only digests that occur more than once are joined
    back, so unique files pass through and a huge group of copies is split by the join.
    """
    groups = files.groupBy(digest).agg(F.min(name).alias("conservado"), F.count("*").alias("n"))
    repeated = groups.filter(F.col("n") > 1).select(digest, "conservado")
    joined = join_unique(files, repeated, [digest])
    return joined.withColumn(
        "duplicado_exacto_de",
        F.when(F.col("conservado") != F.col(name), F.col("conservado")),
    ).drop("conservado")


def unique_files(files: DataFrame, known_copies: DataFrame, name: str) -> DataFrame:
    return files.join(known_copies.select(name), name, "left_anti")
