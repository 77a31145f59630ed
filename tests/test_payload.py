from pyspark.sql import functions as F

from spinecat.functions import payload as P
from spinecat.operators import metrics


def test_truth_rules(spark):
    false = ["null", "false", "0", "0.0", '""', "[]", "{}", "-0"]
    true = ['"false"', "1", '"0"', "[0]", '{"a":1}', "true", "0.1"]
    texts = ['{"x":%s}' % v for v in false + true] + ["{}", "roto", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    rows = df.select("i", P.truthy(P.decode("p"), "x").alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [False] * len(false) + [True] * len(true) + [False] * 4


def test_typed_access(spark):
    df = spark.createDataFrame([('{"a":"5","b":5,"c":null,"d":true}',)], "p string")
    p = P.decode("p")
    row = df.select(
        P.text(p, "a").alias("a"),
        P.text(p, "b").alias("b"),
        P.equals(p, "b", "5").alias("eb"),
        P.equals(p, "a", "5").alias("ea"),
        P.shown(p, "b").alias("sb"),
        P.shown(p, "c").alias("sc"),
        P.shown(p, "d").alias("sd"),
        P.shown(p, "z").alias("sz"),
    ).first()
    assert tuple(row) == ("5", None, False, True, "5", "None", "True", "")


def test_ties_go_to_the_most_recent(spark):
    rows = [
        (1, 1, "busqueda", '{"q":" B ","resultados":0}', "s", "2024-01-01 10:00:00"),
        (2, 1, "busqueda", '{"q":"a","resultados":0}', "s", "2024-01-01 11:00:00"),
        (3, 1, "busqueda", '{"q":"c","resultados":"0"}', "s", "2024-01-01 12:00:00"),
        (4, 1, "busqueda", '{"q":"b"}', "", "2024-01-01 09:00:00"),
        (5, 1, "busqueda", '{"q":7}', None, "2024-01-01 09:00:00"),
        (6, 1, "busqueda", '{"q":"A"}', "t", "2024-01-01 08:00:00"),
    ]
    events = spark.createDataFrame(
        rows, "id long, libreria_id long, tipo string, payload string, session_id string, ts string"
    ).withColumn("creado_en", F.col("ts").cast("timestamp"))
    top = metrics.top_zero_result_terms(events).orderBy("puesto").collect()
    assert [(r.termino, r.n) for r in top] == [("a", 2), ("b", 2)]
    totals = metrics.event_metrics(events).first()
    assert (totals.busquedas_total, totals.busquedas_sin_resultado, totals.sesiones_unicas) == (6, 5, 2)
