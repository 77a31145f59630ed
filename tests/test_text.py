import random
import re
import unicodedata
from urllib.parse import quote

import plain
from pyspark.sql import functions as F

from spinecat.functions import text


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def apply(spark, values, expr):
    rows = column(spark, values).select("i", expr("t").alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def words(n=400):
    rnd = random.Random(3)
    pool = "aB1 -:;—–.'áñÇßﬁ½①가каφ́̈\t\n\xa0éİKÅﬃ𝐀"
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(14))) for _ in range(n)]


def test_fold_key_slug_main_match_plain_python(spark):
    values = words()
    assert apply(spark, values, text.fold) == [plain.ascii_only(v) for v in values]
    assert apply(spark, values, text.key) == [plain.key(v) for v in values]
    assert apply(spark, values, text.main_title) == [plain.main(v) for v in values]
    assert apply(spark, values, text.normal) == [
        re.sub(r"\s+", " ", plain.ascii_only(v).lower().strip()) for v in values
    ]
    assert apply(spark, values, text.slug) == [
        re.sub("[^a-z0-9]+", "-", plain.ascii_only(v).lower()).strip("-") or "libreria"
        for v in values
    ]


def test_search_form_keeps_other_scripts(spark):
    values = words() + ["Ação", "Ёлка", "각 가", "ÀB  C "]
    expected = []
    for v in values:
        bare = "".join(
            c for c in unicodedata.normalize("NFD", v) if not "̀" <= c <= "ͯ"
        )
        expected.append(bare.lower().strip(text.BROWSER_SPACE))
    assert apply(spark, values, text.search_form) == expected


def test_every_code_point_folds_like_the_standard(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    blocks = ["".join(chars[i : i + 400]) for i in range(0, len(chars), 400)]
    assert apply(spark, blocks, text.fold) == [plain.ascii_only(b) for b in blocks]


def test_golden_titles(spark):
    cases = {
        "La Ilíada": ("la iliada", ""),
        "LA ILIADA.": ("la iliada", ""),
        "¡Sin  escape!": ("sin escape", ""),
        "Пушкин": ("", ""),
        "Four Thousand Weeks: Time Management for Mortals": (
            "four thousand weeks time management for mortals",
            "four thousand weeks",
        ),
        "a-b": ("a b", ""),
        ": x": ("x", ""),
        "Rayuela y otros cuentos": ("rayuela y otros cuentos", ""),
    }
    assert apply(spark, list(cases), text.key) == [k for k, _ in cases.values()]
    assert apply(spark, list(cases), text.main_title) == [m for _, m in cases.values()]
    assert apply(spark, ["El Anticuario S.R.L.", ""], text.slug) == [
        "el-anticuario-s-r-l",
        "libreria",
    ]


def test_person_names(spark):
    yes = ["Kafka", "j cortazar", "Newell and Simon", "a b c d e fg", "  Ñandú,  X ", "O'B de Luca"]
    no = ["Ciencia que ladra...", "", "  ", "aa b c d e f g", "X", "O'B", "Пушкин", "Serie Negra", "1984"]
    assert apply(spark, yes + no, text.looks_like_person) == [True] * len(yes) + [False] * len(no)


def test_round_share_is_exact(spark):
    rnd = random.Random(5)
    values = [i / 1000 for i in range(1001)] + [i / 8 for i in range(9)]
    values += [rnd.random() for _ in range(2000)] + [round(rnd.random(), 1) / 4 for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", text.round_share("x").alias("r")
    )
    assert all(r.r == round(r.x, 2) for r in rows.collect())
    beyond = spark.createDataFrame([(7.256,)], "x double").select(text.round_share("x").alias("r"))
    assert beyond.first().r == 7.26


def test_messages_and_links(spark):
    template = "Hola, {titulo} de {autor}. {titulo}?"
    df = spark.createDataFrame(
        [(template, "A $& (B)", ""), (template, "É ~'!*+", "Ana"), ("sin campos", "T", "A")],
        "p string, t string, a string",
    )
    filled = text.message("p", "t", "a")
    rows = df.select(filled.alias("m"), text.whatsapp_link(F.lit("549"), filled).alias("l")).collect()
    assert [r.m for r in rows] == [
        "Hola, A $& (B). {titulo}?",
        "Hola, É ~'!*+ de Ana. {titulo}?",
        "sin campos",
    ]
    for r in rows:
        assert r.l == "https://wa.me/549?text=" + quote(r.m, safe="!'()*~-_.")


def test_overlap_limits(spark):
    def fits(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return df.select(text.enough_overlap(text.tokens("a"), text.tokens("b")).alias("r")).first().r

    assert fits("a b c d e", "a b c x y")
    assert not fits("a b c d e", "a b x y z")
    assert fits("a", "a z") and not fits("a a", "b b") and not fits("", "a")


def test_search_form_orders_marks_as_the_standard(spark):
    rnd = random.Random(11)
    marks = [chr(x) for x in range(0x300, 0x20000) if unicodedata.combining(chr(x))]
    wholes = [chr(x) for x in range(0x483, 0x12000) if len(unicodedata.normalize("NFD", chr(x))) > 1 and not 0xAC00 <= x < 0xD7A4]
    values = []
    for _ in range(400):
        letters = [rnd.choice(["a", "\u00e9", "\u05e9", "\u0628", "\u0915", "\n", rnd.choice(wholes)]) for _ in range(4)]
        values.append("".join(x + "".join(rnd.choices(marks, k=rnd.randrange(5))) for x in letters) + "x")
    values += ["\u05e9\u05bc\u05c1", "\u0301\u034f\u05b0", "a\u05b0\u034f\u0591\u05b0", ""]

    def standard(value):
        bare = "".join(c for c in unicodedata.normalize("NFD", value) if not 0x300 <= ord(c) <= 0x36F)
        return bare.lower().strip(text.BROWSER_SPACE)

    got = apply(spark, values, text.search_form)
    assert [a for a, v in zip(got, values) if a != standard(v)] == []
