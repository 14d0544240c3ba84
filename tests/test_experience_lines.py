import pytest
from pyspark.sql import functions as F

from vitaeflow.functions.register import register
from vitaeflow.operators import experience as E
from vitaeflow.operators import text as X

RUNNING = 2026 * 12 + 9


def entries(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return E.dated_lines(X.with_sections(X.lines_of(df, "id", "t"), "id"), "id", RUNNING)


@pytest.mark.parametrize("line, months", [("Dev at Acme, Since 2022", 58), ("Dev, Acme 01/2021 - 03/2023", 27), ("Dev | Acme (Jan 2021 - Present)", 70), ("Dev 2020-2021", 24), ("BSc 2015 - 2018", None), ("Dev 2023 - 2020", None), ("no dates", None)])
def test_months(spark, line, months):
    got = [r["months"] for r in E.months_by_bucket(entries(spark, line), "id").where("bucket = 'professional'").collect()]
    assert got == ([] if months is None else [months])


def test_titles_and_sections(spark):
    text = "Experience\nBackend Developer | Acme Ltd (2019 - 2020)\nData Analyst\nFoo Inc\n2015 - 2016\nFreelance designer, 2010 - 2011\nEducation\nSomething 2001 - 2004"
    got = [(r["title"], r["company"], r["bucket"]) for r in entries(spark, text).orderBy("line_no").collect()]
    assert got == [("Backend Developer", "Acme Ltd", "professional"), ("Data Analyst", "Foo Inc", "professional"), ("Freelance designer", None, "freelance")]


def test_names(spark):
    df = spark.createDataFrame([("RESUME\nZoë van der Lusk\nx", "File Name"), ("Software Engineer\nno name", "File Name"), (None, "File Name"), ("", None)], "t string, f string")
    assert [r["n"] for r in df.select(E.name_in_head(F.col("t"), F.col("f")).alias("n")).collect()] == ["Zoë van der Lusk", "File Name", "File Name", None]
    assert df.limit(1).select(E.random_window(F.lit("a b c"), F.lit(1), 2).alias("w")).first()["w"] in ("a b", "b c")


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT nfkc('ﬁ') AS a, word_count('x y') AS b, recency_weight(2025, 2026) AS c, candidate_ref('t') AS d, recency_weight(NULL, 2026) AS e, normalize_similarity(0.4D, 0.2D, 0.6D) AS f").first()
    assert (row.a, row.b, round(row.c, 4), row.d[:2], row.e, round(row.f, 3)) == ("fi", 2, 0.7937, "C-", 0.5, 0.5)
    assert [tuple(r) for r in spark.sql("SELECT * FROM extract_entities('a@b.test www.x.io')").collect()] == [("email", "a@b.test"), ("link", "www.x.io")]
