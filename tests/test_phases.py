from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorecast.functions import extraction as X
from lorecast.functions import scores as C
from lorecast.functions.text import specificity
from lorecast.operators import phases as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_contains_join_matches_a_comparison_of_all(spark):
    names = ["Acme Data", "DATABASE", "da", None, "", "Idaho", "Banda"]
    words = ["data", "DAT", "da", "", None, "ban", "idaho"]
    left = spark.createDataFrame([(w,) for w in words], "w string")
    right = spark.createDataFrame([(n,) for n in names], "n string")
    want = sorted((w, n) for w in words for n in names if w and n and len(w) >= 3 and w.lower() in n.lower())
    assert sorted((r.w, r.n) for r in P.contains_join(left, "w", right, "n").collect()) == want
    assert P.contains_join(left.limit(0), "w", right, "n").count() == 0


def test_systematic_sample_is_spread_and_whole_for_small_groups(spark):
    df = spark.createDataFrame([(i, "a") for i in range(100)] + [(i, "b") for i in range(100, 103)], "i int, g string")
    got = P.systematic(df, [F.col("i")], ["g"], 10, 3).collect()
    assert sorted(r.i for r in got) == [*range(3, 100, 10), 100, 101, 102]


def test_repeats_match_a_comparison_of_all(spark):
    import random

    rng = random.Random(1)
    sets = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(80)]
    new, known = sets[:40], sets[40:]
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "k int, w array<string>")
    far = lambda a, b: not a or not b or len(set(a) & set(b)) / len(set(a) | set(b)) <= 0.7
    want = [i for i, a in enumerate(new) if all(far(a, b) for b in known)]
    assert sorted(r.k for r in P.without_repeats(df(new), "k", "w", df(known)).collect()) == want


def test_orchestrator_counts_zeros_in_percentiles(spark):
    df = spark.createDataFrame([("a", 0.9, 0.0), ("b", 0.5, 0.2), ("c", 0.0, 0.0), ("d", 0.1, 0.9)], "id string, x double, y double")
    got = P.orchestrate(df, "id", {"x": 0.6, "y": 0.4}, 2).collect()
    assert [(r.id, round(r.score, 4)) for r in got] == [("a", 0.6), ("b", 0.5)]  # c is no candidate; zeros of the others take part


def test_export_and_publish(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    P.export(rows, rows.agg(F.count("*").alias("n")), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "rows")).count() == 2
    assert spark.read.json(str(tmp_path / "e" / "summary")).first().n == 2
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select(F.to_json(F.struct("id", "t")).alias("v"))
    P.publish(stream, "v", str(tmp_path / "out"), "q").awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1,"t":"x"}', '{"id":2}']


def test_functions_of_empty_and_missing_values(spark):
    null = F.lit(None).cast("string")
    assert one(spark, specificity(F.lit(""))) == 0.3
    assert one(spark, specificity(F.lit("It is so that Some servers at 10.0.0.1 could fail"))) == pytest.approx(0.55)
    assert one(spark, C.edge_category(F.lit("Depends-On"))) == "operational" and one(spark, C.edge_category(null)) == "other"
    assert one(spark, C.compared(F.lit(0.1), F.lit(2.0), F.lit(1.0))) == "new_better"
    assert one(spark, X.repaired_json(F.lit("no brackets"))) is None
    assert one(spark, X.repaired_json(F.lit('```json\n{"a": 1,}\n```'))) == '{"a": 1}'
    assert one(spark, F.size(X.text_time_features(F.lit("")))) == 12
    assert one(spark, X.in_order(F.lit(0.8), F.lit("2025-01-02").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")))["confidence"] == 0.4
