import json
import random

from pyspark.sql import functions as F

from spinecat.functions import text
from spinecat.operators import pages, search
from spinecat.operators.pages import json_pages
from spinecat.sources import files


def test_search_finds_every_substring(spark):
    rnd = random.Random(4)
    letters = "aábñ c"
    books = [
        (i, i % 3, "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 9))), rnd.choice(["", "Ana", "bc"]))
        for i in range(150)
    ]
    queries = [
        (i, i % 4, "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 5)))) for i in range(200)
    ]
    bs = spark.createDataFrame(books, "id long, libreria_id long, titulo string, autor string")
    qs = spark.createDataFrame(queries, "consulta_id long, libreria_id long, q string")

    def plain(v):
        return v.lower().replace("á", "a").replace("ñ", "n").strip()

    def expected(norm, blank):
        return {
            i: (0 if not norm(q) and not blank else sum(
                1 for _, s, t, a in books if s == shop and (norm(q) in norm(t) or norm(q) in norm(a))
            ))
            for i, shop, q in queries
        }

    got = {r.consulta_id: r.resultados for r in search.result_counts(qs, bs).collect()}
    assert got == expected(plain, False)
    panel = search.result_counts(qs, bs, text.inventory_form, blank_finds_all=True)
    assert {r.consulta_id: r.resultados for r in panel.collect()} == expected(lambda v: v.lower().strip(), True)
    hits = {(r.libreria_id, r.termino, r.id) for r in search.hits(qs, bs).collect()}
    assert hits == {
        (shop, plain(q), i)
        for _, shop, q in queries
        if plain(q)
        for i, s, t, a in books
        if s == shop and (plain(q) in plain(t) or plain(q) in plain(a))
    }


def test_few_terms_of_a_shop_need_no_pieces(spark, monkeypatch):
    """Shops below the limit compare books and terms; both ways, and a mixture, find the same."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abc ñ") for _ in range(rnd.randrange(0, n)))
    bs = spark.createDataFrame([(i, i % 3, word(9), word(4)) for i in range(120)], "id long, libreria_id long, titulo string, autor string")
    rows = [(i, min(i % 5, 3), word(4)) for i in range(90)] + [(90, None, "a"), (91, 0, None)]
    qs = spark.createDataFrame(rows, "consulta_id long, libreria_id long, q string")

    def found(direct):
        counts = search.result_counts(qs, bs, direct=direct).collect()
        panel = search.result_counts(qs, bs, text.inventory_form, blank_finds_all=True, direct=direct).collect()
        return sorted(map(str, counts)), sorted(map(str, panel)), sorted(map(str, search.hits(qs, bs, direct=direct).collect()))

    sizes = {s: len({text_ for _, shop, text_ in rows if shop == s}) for s in range(3)}
    by_pieces = found(0)
    assert found(sorted(sizes.values())[1]) == by_pieces
    monkeypatch.setattr(search, "_matches", None)
    assert found(search.DIRECT) == by_pieces


def test_pages_cut_large_keys_and_keep_order(spark):
    rnd = random.Random(2)
    rows = [("grande", rnd.choice("abc"), i) for i in range(57)] + [("chica", "z", 100), ("chica", "y", 101)]
    df = spark.createDataFrame(rows, "slug string, titulo string, id long")
    out = json_pages(df, ["slug"], ["titulo", "id"], F.struct("id"), page_size=10).collect()
    pages = {(r.slug, r.pagina): [x["id"] for x in json.loads(r.documento)] for r in out}
    assert pages[("chica", 0)] == [101, 100]
    ordered = [i for _, _, i in sorted(r for r in rows if r[0] == "grande")]
    assert [pages[("grande", p)] for p in range(6)] == [ordered[p * 10 : p * 10 + 10] for p in range(6)]
    assert all(r.n == len(pages[(r.slug, r.pagina)]) <= 10 for r in out)


def test_catalog_files_are_ordered_by_title(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", 2, "b", "", "2024-01-01"), ("s", 1, "a", "x", "2024-01-01"), ("t", 3, "c", "", "2024-01-02")],
        "slug string, id long, titulo string, autor string, visto string",
    )
    files.write_catalog(df, str(tmp_path / "c"))
    lines = [json.loads(x) for p in sorted((tmp_path / "c" / "slug=s").glob("*.json")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == [1, 2]
    files.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_numbers_do_not_shuffle_rows_for_the_sums_of_ranges(spark):
    """A key that spans ranges, also one without a value, is numbered on; the sums are broadcast."""
    rows = spark.range(0, 2_000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).alias("k"))
    out = pages.numbered(rows, ["k"], ["id"])
    told = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in told and "BroadcastHashJoin" in told
    got = {(r.k, r.id): r.numero for r in out.collect()}
    for k in (None, "x"):
        assert [got[key] for key in sorted((x for x in got if x[0] == k), key=lambda x: x[1])] == list(range(1, sum(x[0] == k for x in got) + 1))


def test_only_keys_of_several_pages_are_numbered(spark, monkeypatch):
    """The rows of small keys go to their page without ranges; equal places do not make a page longer."""
    seen = []
    whole = pages.numbered
    monkeypatch.setattr(pages, "numbered", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    rows = [("grande", 1.0, i) for i in range(25)] + [(f"chica {i}", None, i) for i in range(40)] + [(None, 1.0, 7)] * 3
    df = spark.createDataFrame(rows, "slug string, confianza double, id long")
    out = json_pages(df, ["slug"], ["confianza"], F.struct("id"), page_size=10).collect()
    assert seen == [25]
    assert sorted((r.pagina, r.n, r.paginas) for r in out if r.slug == "grande") == [(0, 10, 3), (1, 10, 3), (2, 5, 3)]
    assert sorted((r.slug or "", r.pagina, r.n) for r in out if r.slug != "grande") == sorted([("", 0, 3)] + [(f"chica {i}", 0, 1) for i in range(40)])
