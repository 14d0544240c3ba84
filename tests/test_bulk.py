import pytest
from pyspark.sql import functions as F

from vitaeflow.operators import bulk as B
from vitaeflow.operators import metrics as M
from vitaeflow.operators import roles
from vitaeflow.operators.joins import join_lookup, pairs_in_blocks


def test_status_and_counts(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (4, "  ", "z"), (5, "b", "z")], "k long, t string, status string")
    s = B.file_status(df, "k", "t")
    assert {(r["k"], r["status"], r["first_key"]) for r in s.collect()} == {(3, "duplicate", 1), (1, "analyzed", 1), (2, "failed", 2), (4, "failed", 4), (5, "analyzed", 5)}
    assert {r["status"]: r["n"] for r in B.status_counts(s).collect()} == {"duplicate": 1, "analyzed": 2, "failed": 2, "total": 5}
    assert {r["status"]: r["n"] for r in B.status_counts(B.file_status(df.limit(0), "k", "t")).collect()} == {"total": 0}


@pytest.mark.parametrize("full, prof, intern, said, years", [(24, 30, 6, 9, 2.0), (0, 18, 0, 9, 1.5), (0, 18, 6, 4, 4.0), (None, None, None, None, 0.0), (0, 0, 0, 0, 0.0)])
def test_years(spark, full, prof, intern, said, years):
    df = spark.createDataFrame([(full, prof, intern, said)], "a int, b int, c int, d int")
    assert df.select(B.candidate_years(df.a, df.b, df.c, df.d).alias("y")).first()["y"] == years


def test_fits_and_weights(spark):
    df = spark.createDataFrame([(2.0, 4, 3, 4), (9.0, 4, 4, 4), (0.0, None, 0, 0)], "y double, ry int, d int, rd int")
    assert [tuple(r) for r in df.select(B.years_fit(F.col("y"), F.col("ry")), B.degree_fit(F.col("d"), F.col("rd"))).collect()] == [(0.5, 0.5), (1.0, 1.0), (1.0, 1.0)]
    w = B.with_weight("composite", "recency", 0.0)
    assert w == B.rescaled("composite", "recency") | {"recency": 0.0} and sum(w.values()) == pytest.approx(1) and w["skill"] == pytest.approx(0.4 / 0.85)


def test_redaction_recall(spark):
    labels = spark.createDataFrame([("f", "EMAIL", "a@b.test"), ("f", "e-mail", "c@d.test"), ("f", None, "Zed"), ("f", "name", " "), ("g", "name", "Zed")], "file string, kind string, value string")
    texts = spark.createDataFrame([("f", "[EMAIL] C@D.test zed", 1)], "file string, red string, kind int")
    got = {r["pii_type"]: (r["labelled"], r["gone"], r["recall"]) for r in B.redaction_recall(labels, texts, "file", "kind", "value", "red").collect()}
    assert got == {"email": (2, 1, 0.5), "unknown": (1, 0, 0.0), "micro": (3, 1, 0.3333), "macro": (3, 1, 0.25)}


def test_paired_tests(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip((125, 115, 130, 140, 140, 115, 140, 125, 140, 135), (110, 122, 125, 120, 140, 124, 123, 137, 135, 145))], "a double, b double")
    r = M.paired_difference(df, "a", "b").first()
    assert (r["n"], r["mean"], r["w"]) == (10, 2.4, 18.0) and r["t"] == pytest.approx(0.6363, abs=1e-3) and r["p"] == pytest.approx(0.5404, abs=2e-3) and r["p_signed"] == pytest.approx(0.594, abs=5e-3)
    assert M.paired_difference(df.limit(0), "a", "b").first()["p"] is None


def test_pairs_in_blocks_and_hot_lookups(spark):
    items = spark.createDataFrame([("g", i) for i in range(23)] + [("h", 1), (None, 5), ("g", None)], "g string, i int")
    got = [(r["x"], r["y"]) for r in pairs_in_blocks(items, "g", "i", 5).collect()]
    assert sorted(got) == [(a, b) for a in range(23) for b in range(a + 1, 23)]
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1), ("none", 1)], "k string, v int")
    look = spark.createDataFrame([("hot", 1, 3000)] + [(f"k{i}", 2, 1) for i in range(50)], "k string, x int, n int")
    out = join_lookup(rows, look, ["k"], "n")
    assert out.count() == 3050 and out.columns == ["k", "v", "x"] and out.where("x = 1").count() == 3000


def test_titles_with_signs(spark):
    df = spark.createDataFrame([("C++ developer at Acme",)], "t string")
    assert df.select(roles.without_title_words(F.col("t"), ["C++ developer"]).alias("x")).first()["x"].split() == ["at", "Acme"]
    assert df.select(roles.without_title_words(F.col("t"), []).alias("x")).first()["x"] == "C++ developer at Acme"
