"""Model answers (one JSON text per photo) to clean book readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinecat import schemas
from spinecat.functions import payload as P
from spinecat.functions import text

# Member names of a model answer.
LIST = "libros"
TEXTS = ["titulo_detectado", "autor_detectado", "titulo_corregido", "autor_corregido"]


def unfence(col: Column | str, lenient: bool = False) -> Column:
    """Take a Markdown fence off; the lenient form also cuts to the outermost braces."""
    body = text.strip(text.or_empty(col))
    inner = F.btrim(body, F.lit("`"))
    inner = F.when(
        F.lower(F.substring(inner, 1, 4)) == "json", F.substr(inner, F.lit(5))
    ).otherwise(inner)
    plain = F.when(body.startswith("```"), text.strip(inner)).otherwise(body)
    if not lenient:
        return plain
    braces = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    whole = plain.startswith("{") & plain.endswith("}")
    return F.when(whole, plain).when(braces != "", braces).otherwise(plain)


def _is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def read(responses: DataFrame, lenient: bool = False) -> DataFrame:
    """Answers with ``libros`` as an array of variants, or the reason why there is none.

    The lenient form reads answers for evaluation, where a missing list counts as empty.
    """
    doc = responses.withColumn("doc", F.try_parse_json(unfence("texto", lenient)))
    lists = doc.withColumn(LIST, F.try_variant_get("doc", f"$.{LIST}", "array<variant>"))
    missing = F.try_variant_get("doc", f"$.{LIST}", "variant").isNull()
    # The chain stops at the first branch for good answers; the rest is for failed ones only.
    reason = (
        F.when(F.col(LIST).isNotNull(), F.lit(None))
        .when(F.col("doc").isNull(), "json")
        .when(~_is_object(F.col("doc")), "objeto")
        .when(missing, F.lit(None) if lenient else F.lit("clave"))
        .otherwise("lista")
    )
    return lists.withColumn("motivo", reason).drop("doc", "texto")


def parse(responses: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readable answers, failed answers with a reason)."""
    answers = read(responses, lenient)
    return (
        answers.filter(F.col("motivo").isNull()).drop("motivo"),
        answers.filter(F.col("motivo").isNotNull()).drop(LIST),
    )


# Texts that may be a falsy value or a word of another type; only these look at the JSON type.
_AMBIGUOUS = r"^(true|false|-?[0.]+([eE][+-]?\d+)?)?$"


#: Members of a book that are read at once; one of another type is NULL here.
_MEMBERS = f"struct<{', '.join(f'{name}: string' for name in TEXTS)}, confianza: double>"


def _members(book: Column) -> Column:
    """The members of an object as texts and a number; NULL for what is no object."""
    return F.try_variant_get(book, "$", _MEMBERS)


def _words(book: Column, members: Column, name: str) -> Column:
    """Text of a member, trimmed; a falsy member is empty."""
    value = members[name]
    typed = F.when(P.truthy(book, name), P.shown(book, name)).otherwise(F.lit(""))
    unsure = value.isNull() | value.rlike(_AMBIGUOUS)
    return text.strip(F.when(value == "", value).when(unsure, typed).otherwise(value))


def _filled(book: Column, members: Column, name: str) -> Column:
    """Truth of a text member as it stands, before trimming: blanks are a value."""
    value = members[name]
    unsure = value.isNull() | value.rlike(_AMBIGUOUS)
    return F.when(value == "", F.lit(False)).when(unsure, P.truthy(book, name)).otherwise(F.lit(True))


def _level(book: Column, members: Column) -> Column:
    number = members["confianza"]
    return F.when(number.isNotNull(), number).when(~P.truthy(book, "confianza"), F.lit(0.0))


def _made_up(corrected: Column, detected: Column) -> Column:
    """An author without a person on the spine."""
    return (corrected != "") & ~text.looks_like_person(detected)


def _capped(level: Column) -> Column:
    return F.when(level.isNotNull(), F.least(level, F.lit(schemas.GUARD_CONFIDENCE)))


def guard_author(rows: DataFrame) -> DataFrame:
    """Blank an author the model made up: a corrected author without a person on the spine.

    The dropped name is kept apart and the confidence capped, so that review marks it.
    """
    author, level = F.col("autor_corregido"), F.col("confianza")
    return (
        rows.withColumn("frenado", _made_up(author, F.col("autor_detectado")))
        .withColumn("autor_descartado", F.when(F.col("frenado"), author))
        .withColumn("autor_corregido", F.when(F.col("frenado"), F.lit("")).otherwise(author))
        .withColumn("confianza", F.when(F.col("frenado"), _capped(level)).otherwise(level))
        .drop("frenado")
    )


def books(answers: DataFrame) -> DataFrame:
    """``read`` answers with ``libros`` as guarded books, one struct for each JSON object.

    ``pos`` is the place in the answer's list; ``titulo`` the corrected title or, where that
    member is falsy, the detected one. An answer stays one row; a failed one has no books.
    """
    told = F.transform(LIST, lambda v, i: F.struct(i.alias("pos"), v.alias("v"), _members(v).alias("m")))
    objects = F.filter(told, lambda x: x["m"].isNotNull())
    plain = F.transform(
        objects,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            *[_words(x["v"], x["m"], name).alias(name) for name in TEXTS],
            _filled(x["v"], x["m"], "titulo_corregido").alias("hay"),
            _level(x["v"], x["m"]).alias("confianza"),
        ),
    )
    marked = F.transform(
        plain,
        lambda b: F.struct(b.alias("b"), _made_up(b["autor_corregido"], b["autor_detectado"]).alias("frenado")),
    )
    guarded = F.transform(
        marked,
        lambda m: F.struct(
            m["b"]["pos"].alias("pos"),
            F.when(m["b"]["hay"], m["b"]["titulo_corregido"]).otherwise(m["b"]["titulo_detectado"]).alias("titulo"),
            F.when(m["frenado"], F.lit("")).otherwise(m["b"]["autor_corregido"]).alias("autor"),
            F.when(m["frenado"], _capped(m["b"]["confianza"])).otherwise(m["b"]["confianza"]).alias("confianza"),
            F.when(m["frenado"], m["b"]["autor_corregido"]).alias("autor_descartado"),
        ),
    )
    return answers.withColumn(LIST, F.coalesce(guarded, F.array().cast(guarded_type())))


def guarded_type() -> str:
    return "array<struct<pos:int,titulo:string,autor:string,confianza:double,autor_descartado:string>>"


def _rows(answers: DataFrame) -> DataFrame:
    """One row per member of the lists, NULL in ``pos`` where it is no object; an empty list gives one row."""
    photo = [c for c in answers.columns if c != LIST]
    exploded = answers.select(*photo, F.posexplode_outer(LIST).alias("pos", "libro"))
    exploded = exploded.withColumn("partes", _members(F.col("libro")))
    book, members = F.col("libro"), F.col("partes")
    return exploded.select(
        *photo,
        F.when(members.isNotNull(), F.col("pos")).alias("pos"),
        *[_words(book, members, name).alias(name) for name in TEXTS],
        _filled(book, members, "titulo_corregido").alias("hay"),
        _level(book, members).alias("confianza"),
    )


def _usable() -> Column:
    return F.col("pos").isNotNull() & (F.col("titulo_detectado") != "")


def _finish(rows: DataFrame) -> DataFrame:
    title = F.when(F.col("hay"), F.col("titulo_corregido")).otherwise(F.col("titulo_detectado"))
    return guard_author(rows).withColumn("titulo_corregido", title).drop("hay")


def readings(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per usable detected book, rows whose confidence is not a number).

    No filter stands on the parsed list: it would be pushed below the parsing and parse every
    text twice.
    """
    usable = _rows(answers).filter(_usable())
    bad = F.col("confianza").isNull()
    return _finish(usable.filter(~bad)), _finish(usable.filter(bad))


def whole_readings(answers: DataFrame, photo: str = "foto_id") -> DataFrame:
    """``readings`` of the photos of which no usable book has a confidence that is no number.

    The rows of a photo are looked at together where they are parsed, so no text is parsed once more to
    find the photos to leave out; a window holds the books of one photo.
    """
    use = _usable()
    odd = F.max(use & F.col("confianza").isNull()).over(Window.partitionBy(photo))
    marked = _rows(answers).withColumns({"usable": use, "rara": odd})
    return _finish(marked.filter("usable AND NOT rara").drop("usable", "rara"))
