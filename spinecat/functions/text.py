"""Text rules as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when trimming server-side text and browser text.
SERVER_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BROWSER_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Patterns of the title and author rules.
SUBTITLE_BREAK = "[:;]| - | — | – "
WORD_BREAK = r"\s\x1c-\x1f,.&\-"
COLLECTION_MARKERS = [
    "coleccion",
    "colecc",
    "serie",
    "biblioteca",
    "ediciones",
    "editorial",
    "ciencia que ladra",
    "claves para todos",
    "que ladra",
]
MAX_NAME_WORDS = 6

_ASCII_SPACE = r"[\s\x1c-\x1f]+"
_NON_ASCII = r"[^\x00-\x7F]"


def _text(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str, chars: str = SERVER_SPACE) -> Column:
    return F.btrim(_text(col), F.lit(chars))


def or_empty(col: Column | str) -> Column:
    return F.coalesce(_text(col), F.lit(""))


# --- accent folding -----------------------------------------------------------------------

# No character from here on decomposes to anything with ASCII letters or accents.
_CODE_POINTS = range(0x80, 0x30000)


@cache
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions with an ASCII part: one-letter pairs, and longer ones."""
    source, target, longer = [], [], {}
    for code in _CODE_POINTS:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(source), "".join(target), longer


@cache
def _search_tables() -> tuple[str, str, dict[str, str]]:
    """Canonical decompositions without U+0300..U+036F, Hangul syllables left out."""
    source, target, longer = [], [], {}
    for code in _CODE_POINTS:
        char = chr(code)
        if 0x300 <= code <= 0x36F or 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        full = unicodedata.normalize("NFD", char)
        rest = "".join(c for c in full if not 0x300 <= ord(c) <= 0x36F)
        if rest == char:
            continue
        if len(rest) == 1:
            source.append(char)
            target.append(rest)
        else:
            longer[char] = rest
    return "".join(source), "".join(target), longer


def _spell_out(col: Column, table: dict[str, str]) -> Column:
    """Replace single characters by longer strings, only in the rows that contain one."""
    pairs = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    letters = F.regexp_extract_all(col, F.lit("(?s)(.)"), 1)
    spelled = F.array_join(
        F.transform(letters, lambda c: F.coalesce(F.try_element_at(pairs, c), c)), ""
    )
    # A hash lookup per character; a pattern of several hundred letters is tried one by one.
    without = F.translate(col, "".join(table), "")
    return F.when(F.length(without) < F.length(col), spelled).otherwise(col)


def fold(col: Column | str) -> Column:
    """ASCII skeleton: compatibility-decompose, then drop what is not ASCII.

    Pure ASCII rows, the large majority, only pay for one pattern test.
    """
    text = or_empty(col)
    source, target, longer = _ascii_tables()
    plain = F.regexp_replace(
        F.translate(_spell_out(text, longer), source, target), _NON_ASCII, ""
    )
    return F.when(text.rlike(_NON_ASCII), plain).otherwise(text)


def _open_hangul(col: Column) -> Column:
    """Write Hangul syllables as their letters (the arithmetic rule of the Unicode standard)."""
    lead = "".join(chr(0x1100 + i) for i in range(19))
    vowel = "".join(chr(0x1161 + i) for i in range(21))
    tail = "".join(chr(0x11A8 + i) for i in range(27))

    def spell(c: Column) -> Column:
        index = F.ascii(c) - F.lit(0xAC00)
        return F.when(
            (index >= 0) & (index < 11172),
            F.concat(
                F.substr(F.lit(lead), F.floor(index / 588).cast("int") + 1, F.lit(1)),
                F.substr(
                    F.lit(vowel), F.floor((index % 588) / 28).cast("int") + 1, F.lit(1)
                ),
                F.when(
                    index % 28 > 0, F.substr(F.lit(tail), (index % 28).cast("int"), F.lit(1))
                ).otherwise(F.lit("")),
            ),
        ).otherwise(c)

    letters = F.regexp_extract_all(col, F.lit("(?s)(.)"), 1)
    return F.when(
        col.rlike(r"[\uac00-\ud7a3]"), F.array_join(F.transform(letters, spell), "")
    ).otherwise(col)


@cache
def _mark_tables() -> tuple[str, str, str]:
    """Marks with a combining class, a letter in the order of these classes for each, and their pattern."""
    codes = [code for code in _CODE_POINTS if unicodedata.combining(chr(code))]
    ranges = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    marks = "".join(map(chr, codes))
    classes = "".join(chr(0x4E00 + unicodedata.combining(x)) for x in marks)
    return marks, classes, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _order_marks(col: Column) -> Column:
    """Canonical order: the marks of each run by combining class, equal classes as they stand."""
    marks, classes, pattern = _mark_tables()

    def ordered(piece: Column) -> Column:
        letters = F.regexp_extract_all(piece, F.lit("(?s)(.)"), 1)
        placed = F.transform(
            letters, lambda c, i: F.struct(F.translate(c, marks, classes).alias("k"), i.alias("i"), c.alias("c"))
        )
        return F.array_join(F.transform(F.array_sort(placed), lambda x: x["c"]), "")

    pieces = F.regexp_extract_all(col, F.lit(f"([{pattern}]+|[^{pattern}]+)"), 1)
    run = f"[{pattern}]{{2}}"
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(run), ordered(p)).otherwise(p)), "")


def search_form(col: Column | str) -> Column:
    """Public search: decompose, drop combining accents only, lower, trim; other scripts survive."""
    text = or_empty(col)
    source, target, longer = _search_tables()
    opened = _open_hangul(_spell_out(F.translate(text, source, target), longer))
    # Below U+0483 there are no marks but the ones that are dropped.
    sorted_ = F.when(text.rlike(r"[\x{483}-\x{10ffff}]"), _order_marks(opened)).otherwise(opened)
    bare = F.regexp_replace(sorted_, r"[\u0300-\u036f]", "")
    return strip(
        F.lower(F.when(text.rlike(_NON_ASCII), bare).otherwise(text)), BROWSER_SPACE
    )


def inventory_form(col: Column | str) -> Column:
    """Panel search: lower and trim, accents kept."""
    return strip(F.lower(or_empty(col)), BROWSER_SPACE)


def normal(col: Column | str) -> Column:
    """Folded, lower, trimmed, white space collapsed."""
    lowered = F.btrim(F.lower(fold(col)), F.lit(SERVER_SPACE))
    return F.regexp_replace(lowered, _ASCII_SPACE, " ")


def key(col: Column | str) -> Column:
    """Matching key: folded, lower, every run of other characters becomes one space."""
    return F.trim(F.regexp_replace(F.lower(fold(col)), "[^a-z0-9]+", " "))


def slug(col: Column | str) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(fold(col)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(dashed == "", F.lit("libreria")).otherwise(dashed)


def book_key(title: Column | str, author: Column | str) -> tuple[Column, Column]:
    return key(title), key(author)


def main_title(col: Column | str) -> Column:
    """Key of the part before the first subtitle break; empty when it is the whole key."""
    text = or_empty(col)
    head = key(F.get(F.split(text, SUBTITLE_BREAK, 2), F.lit(0)))
    return F.when(text.rlike(SUBTITLE_BREAK) & (head != key(text)), head).otherwise(F.lit(""))


def term_key(col: Column | str) -> Column:
    """Search-term key of the reports: trimmed and lower, accents kept."""
    return F.lower(strip(or_empty(col)))


# --- author heuristics --------------------------------------------------------------------


def looks_like_person(col: Column | str) -> Column:
    """One to six words, one of them all letters, and no word of a publisher's series.

    A single pattern, so that the folded text is computed once.
    """
    gap, word = f"[{WORD_BREAK}]", f"[^{WORD_BREAK}]"
    pattern = (
        f"(?s)^(?!.*(?:{'|'.join(COLLECTION_MARKERS)}))"
        rf"(?=(?:.*{gap})?[a-z]{{2,}}(?:{gap}|\z))"
        rf"{gap}*+(?:{word}++{gap}*+){{1,{MAX_NAME_WORDS}}}+\z"
    )
    return F.lower(fold(strip(or_empty(col)))).rlike(pattern)


# --- comparisons --------------------------------------------------------------------------


def tokens(col: Column | str) -> Column:
    """Words of a key; none for the empty key."""
    return F.filter(F.split(_text(col), " "), lambda w: w != "")


def contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def common_words(a: Column, b: Column) -> Column:
    """Size of the set of words both lists share."""
    return F.size(F.array_intersect(a, b))


def enough_overlap(a: Column, b: Column) -> Column:
    """Shared words reach 60 % of the shorter list, and at least one."""
    wanted = F.greatest(F.lit(1.0), F.least(F.size(a), F.size(b)) * F.lit(0.6))
    return common_words(a, b) >= wanted


# --- links, dates, numbers ----------------------------------------------------------------


def _first(col: Column, needle: str, value: Column) -> Column:
    """Replace the first occurrence only, literally."""
    at = F.instr(col, needle)
    return F.when(
        at > 0,
        F.concat(
            F.substr(col, F.lit(1), at - 1),
            value,
            F.substr(col, at + F.lit(len(needle))),
        ),
    ).otherwise(col)


def message(template: Column | str, title: Column | str, author: Column | str) -> Column:
    """Fill the consultation text; without an author its `` de {autor}`` goes away."""
    author = or_empty(author)
    base = F.when(author == "", _first(_text(template), " de {autor}", F.lit(""))).otherwise(
        _text(template)
    )
    return _first(_first(base, "{titulo}", or_empty(title)), "{autor}", author)


# What a visitor writes when a search finds nothing, or before any search.
NOT_FOUND = 'Hola! Busqué "{q}" en tu catálogo y no lo encontré. ¿Lo tenés igual o me avisás si lo conseguís?'
NO_SEARCH = "Hola! Quería consultarte por un libro que no encontré en tu catálogo."


def not_found_message(q: Column | str) -> Column:
    """Consultation text for a search without result; blank entries get the general one."""
    entry = strip(or_empty(q))
    head, tail = NOT_FOUND.split("{q}")
    return F.when(entry == "", F.lit(NO_SEARCH)).otherwise(F.concat(F.lit(head), entry, F.lit(tail)))


def url_component(col: Column | str) -> Column:
    """Percent-encode as browsers do for a URI component."""
    encoded = F.url_encode(_text(col))
    for coded, plain in [
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ]:
        encoded = F.replace(encoded, F.lit(coded), F.lit(plain))
    return encoded


def whatsapp_link(phone: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("https://wa.me/"), _text(phone), F.lit("?text="), url_component(text))


def qr_target(base: str, slug_col: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), _text(slug_col), F.lit("?src=qr"))


def iso_date(col: Column | str) -> Column:
    return F.date_format(_text(col), "yyyy-MM-dd")


def day_month(col: Column | str) -> Column:
    return F.date_format(_text(col), "dd/MM")


def round_share(col: Column | str) -> Column:
    """Two decimals, half to even on the exact binary value, for numbers from 0 to 1.

    ``bround`` works on the shortest decimal text of the double, so 0.175 (stored a little
    lower) would go up; scaling by a power of two is exact and keeps the true side. Numbers
    outside the range, which no confidence should be, fall back to ``bround``.
    """
    value = _text(col)
    scale = 1 << 62
    wide = F.lit(scale).cast("decimal(20,0)")
    exact = (value * F.lit(float(scale))).cast("long").cast("decimal(20,0)") * F.lit(100).cast(
        "decimal(3,0)"
    )
    whole = F.floor(exact / wide).cast("long")
    rest = exact - whole.cast("decimal(5,0)") * wide
    half = F.lit(scale // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    rounded = (whole + up.cast("long")) / F.lit(100.0)
    return F.when(value.between(0, 1), rounded).otherwise(F.bround(value, 2))
