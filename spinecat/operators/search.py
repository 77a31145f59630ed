"""Many search-box entries against the catalogues of their shops.

A shop with few different terms compares each of its books with all of them: that is bounded
work per book, and only the books themselves are shuffled, once. The others go by pieces.

A substring can sit inside a word, so words are no safe blocking key; character grams are.
Every text offers its one-, two- and three-character pieces; an entry asks with a single
piece, the rarest of its own. Whatever contains the entry contains that piece, so nothing is
lost, and a shop never has to compare all entries with all books. Repeated entries and
repeated books are collapsed before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinecat.functions import text
from spinecat.operators.joins import join_unique
from spinecat.session import materialise

GRAM = 3

#: Different terms up to which a shop's books are compared with each of them.
DIRECT = 128


def _pieces(col: Column, size: int) -> Column:
    """All substrings of one length; the lookahead lets matches overlap."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def _face_pieces(faces: DataFrame, sizes: list[int]) -> DataFrame:
    """(libreria_id, cara, pieza): the texts themselves stay behind."""
    parts = [_pieces(F.col(c), size) for c in ("t", "a") for size in sizes]
    return faces.select(
        "libreria_id", "cara", F.explode(F.array_distinct(F.concat(*parts))).alias("pieza")
    )


def _prepare(
    queries: DataFrame, books: DataFrame, form: Callable[[Column | str], Column]
) -> tuple[DataFrame, DataFrame]:
    """Entries with their term, and books with their texts and a number for these (``cara``)."""
    asked = queries.withColumn("termino", form("q"))
    shelf = books.withColumns({"t": form("titulo"), "a": form("autor")})
    return asked, shelf.withColumn("cara", F.xxhash64("t", "a"))


def _offered(faces: DataFrame, terms: DataFrame) -> DataFrame:
    """Pieces of the texts; the short ones only in shops that were asked for a short term."""
    short_shops = terms.filter(F.length("termino") < GRAM).select("libreria_id").distinct()
    return _face_pieces(faces, [GRAM]).unionByName(
        _face_pieces(
            join_unique(faces, short_shops, ["libreria_id"], "left_semi"), list(range(1, GRAM))
        )
    )


def _matches(terms: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the terms that occur in their title or author.

    The pieces are built once and kept where some term has them. Each term asks with the one of
    its pieces that the fewest texts of the shop contain. Only face numbers travel with the
    pieces; the texts are joined back for the check.
    """
    keys = ["libreria_id", "pieza"]
    own = F.when(F.length("termino") < GRAM, F.array("termino")).otherwise(
        F.array_distinct(_pieces(F.col("termino"), GRAM))
    )
    asked = terms.withColumn("pieza", F.explode(own))
    wanted = materialise(
        join_unique(_offered(faces, terms), asked.select(*keys).distinct(), keys, "left_semi")
    )
    frequency = wanted.groupBy(*keys).agg(F.count("*").alias("veces"))
    # A piece the shop does not have sorts first and then simply finds no partner.
    rarest = F.min_by("pieza", F.struct(F.coalesce("veces", F.lit(0)), "pieza"))
    chosen = (
        join_unique(asked, frequency, keys)
        .groupBy("libreria_id", "termino")
        .agg(rarest.alias("pieza"))
    )
    pairs = wanted.join(chosen, keys).select("libreria_id", "cara", "termino")
    found = pairs.join(faces, ["libreria_id", "cara"])
    return found.filter(F.contains("t", "termino") | F.contains("a", "termino"))


def _asked_terms(asked: DataFrame, blank: bool) -> DataFrame:
    """Distinct terms of each shop, with their number in the shop (``cuantos``)."""
    rows = asked if blank else asked.filter(F.col("termino") != "")
    terms = rows.select("libreria_id", "termino").distinct()
    sizes = terms.groupBy("libreria_id").agg(F.count("*").alias("cuantos"))
    return materialise(join_unique(terms, sizes, ["libreria_id"]))


def _compared(shelf: DataFrame, few: DataFrame, keep: list[str]) -> DataFrame:
    """Books with the terms that occur in them, each book against the short list of its shop."""
    lists = few.groupBy("libreria_id").agg(F.collect_list("termino").alias("terminos"))
    rows = join_unique(shelf.select("libreria_id", "t", "a", *keep), lists, ["libreria_id"], "inner")
    found = F.filter("terminos", lambda x: F.contains(F.col("t"), x) | F.contains(F.col("a"), x))
    return rows.select("libreria_id", *keep, F.explode(found).alias("termino"))


def _split(terms: DataFrame, direct: int) -> tuple[DataFrame, DataFrame | None]:
    """Terms of the shops with up to ``direct`` of them, and those of the others if there are any."""
    many = terms.filter(F.col("cuantos") > direct).select("libreria_id", "termino")
    return terms.filter(F.col("cuantos") <= direct), None if many.isEmpty() else many


def _of_shops(shelf: DataFrame, terms: DataFrame) -> DataFrame:
    return join_unique(shelf, terms.select("libreria_id").distinct(), ["libreria_id"], "left_semi")


def result_counts(
    queries: DataFrame,
    books: DataFrame,
    form: Callable[[Column | str], Column] = text.search_form,
    blank_finds_all: bool = False,
    direct: int = DIRECT,
) -> DataFrame:
    """Number of results of each entry, as the search events record it."""
    asked, shelf = _prepare(queries, books, form)
    # The empty term occurs in every book.
    few, many = _split(_asked_terms(asked, blank_finds_all), direct)
    counts = _compared(shelf, few, []).groupBy("libreria_id", "termino").agg(F.count("*").alias("resultados"))
    if many is not None:
        own = _of_shops(shelf, many)
        faces = own.groupBy("libreria_id", "cara", "t", "a").agg(F.count("*").alias("n"))
        found = _matches(many.filter(F.col("termino") != ""), faces)
        counts = counts.unionByName(found.groupBy("libreria_id", "termino").agg(F.sum("n").alias("resultados")))
        if blank_finds_all:
            everything = own.groupBy("libreria_id").agg(F.count("*").alias("resultados"))
            counts = counts.unionByName(everything.withColumn("termino", F.lit("")))
    return (
        join_unique(asked, counts, ["libreria_id", "termino"])
        .fillna(0, ["resultados"])
        .select("consulta_id", "libreria_id", "termino", "resultados")
    )


def hits(
    queries: DataFrame,
    books: DataFrame,
    form: Callable[[Column | str], Column] = text.search_form,
    direct: int = DIRECT,
) -> DataFrame:
    """Books found by each distinct term of a shop."""
    asked, shelf = _prepare(queries, books, form)
    few, many = _split(_asked_terms(asked, False), direct)
    found = _compared(shelf, few, ["id"]).select("libreria_id", "termino", "id")
    if many is None:
        return found
    own = _of_shops(shelf, many)
    faces = own.select("libreria_id", "cara", "t", "a").distinct()
    by_pieces = (
        _matches(many, faces)
        .select("libreria_id", "termino", "cara", "t", "a")
        .join(own.select("libreria_id", "cara", "t", "a", "id"), ["libreria_id", "cara", "t", "a"])
        .select("libreria_id", "termino", "id")
    )
    return found.unionByName(by_pieces)
