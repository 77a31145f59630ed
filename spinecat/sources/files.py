"""File sources and sinks around the stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.operators import ids

# Forms of the service log lines.
LOG_KIND = r"\b(vision_ok|vision_fallo|lote_procesado)\b"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema; nothing is inferred."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows in the full layout of a table, as its defaults complete them.

    Without a creation time it is now, for ``activa`` it is true; other missing columns are NULL.
    """
    defaults = {"creado_en": F.current_timestamp(), "activa": F.lit(True)}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.TABLES[name]
        ]
    )


def _mark(spark: SparkSession, root: str, name: str) -> int:
    """The greatest id of a stored table, 0 where there is no table yet."""
    try:
        return ids.high_water(read_table(spark, root, name))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


#: Columns that tell the rows of a table apart before they have an id; the others of a table follow.
NATURAL = {"fotos": ["lote_id", "orden"], "lotes": ["libreria_id"], "librerias": ["slug"]}


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Append rows to a stored table (or overwrite it).

    Rows without ids get those after the greatest stored one, without gaps, in the order of their
    own columns; a repeated write of a failed one gives the same rows. One writer at a time.
    """
    if "id" not in df.columns:
        orderable = [f.name for f in df.schema if f.name in schemas.TABLES[name].names and f.name != "creado_en"]
        first = [x for x in NATURAL.get(name, []) if x in orderable]
        above = 0 if mode == "overwrite" else _mark(df.sparkSession, root, name)
        df = ids.allocate(df, [*first, *(x for x in orderable if x not in first)], above)
    stored(df, name).write.mode(mode).parquet(f"{root}/{name}")


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Catalogue as JSON lines by shop, in title order, large shops over several files."""
    ordered = catalog.repartitionByRange("slug", "titulo", "id").sortWithinPartitions(
        "slug", "titulo", "id"
    )
    ordered.write.mode("overwrite").partitionBy("slug").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def truth_photos(docs: DataFrame, col: str = "texto") -> DataFrame:
    """Photo and its expected books (array) from JSON maps photo -> expected books.

    A map in a column of its own would be parsed twice: a filter on its size goes below the parsing.
    """
    return docs.select(F.explode(F.from_json(col, schemas.VERDAD)).alias("foto", "esperados"))


def truth_rows(docs: DataFrame, col: str = "texto") -> DataFrame:
    """One row per expected book, keeping its position."""
    photos = truth_photos(docs, col)
    return photos.select("foto", F.posexplode("esperados").alias("pos", "e")).select(
        "foto", "pos", "e.titulo", "e.autor", "e.autor_visible_en_foto", "e.nota"
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "texto"))


def is_image(path: Column) -> Column:
    endings = "|".join(s.lstrip(".") for s in schemas.IMAGE_SUFFIXES)
    return F.lower(path).rlike(rf"\.({endings})$")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(nombre, huella) of the images of a folder; the bytes are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(is_image(F.col("path"))).select(
        F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("nombre"),
        F.md5("content").alias("huella"),
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Model-call and batch lines of the service log; other lines are left out."""
    line = F.col("value")

    def number(name: str) -> Column:
        return F.regexp_extract(line, rf"\b{name}=(\d+)", 1).try_cast("long")

    def token(name: str) -> Column:
        return F.regexp_extract(line, rf"'{name}': ([0-9.eE+-]+)", 1)

    rows = lines.select(
        F.regexp_extract(line, LOG_KIND, 1).alias("clase"),
        number("intento").alias("intento"),
        F.nullif(F.regexp_extract(line, r"\bmodelo=(\S+)", 1), F.lit("")).alias("modelo"),
        number("latencia_ms").alias("latencia_ms"),
        token("prompt_tokens").try_cast("long").alias("tokens_entrada"),
        token("completion_tokens").try_cast("long").alias("tokens_salida"),
        token("cost").try_cast("double").alias("costo"),
        number("lote_id").alias("lote_id"),
        number("libreria_id").alias("libreria_id"),
        number("nuevos").alias("nuevos"),
        number("duplicados").alias("duplicados"),
    )
    return rows.filter(F.col("clase") != "")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))
