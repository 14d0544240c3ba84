import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitaeflow.functions.dates import month_indexes, written_period
from vitaeflow.operators.intervals import merge_intervals
from vitaeflow.operators.profile import merged_months


def brute(rows):
    out = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e >= s:
            out.setdefault(k, set()).update(range(s, e + 1))
    res = set()
    for k, months in out.items():
        ms = sorted(months)
        start = prev = ms[0]
        for m in ms[1:] + [None]:
            if m is None or m > prev + 1:
                res.add((k, "period", start, prev))
                if m is not None:
                    res.add((k, "gap", prev + 1, m - 1))
                    start = m
            prev = m
    return res


row = st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 40)), st.one_of(st.none(), st.integers(0, 40)))


@settings(max_examples=15, deadline=None)
@given(st.lists(row, max_size=25))
def test_merge_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, s int, e int")
    got = {(r["k"], r["kind"], r["s"], r["e"]) for r in merge_intervals(df, "k", "s", "e").collect()}
    assert got == brute(rows)


def test_clashing_names_ties_and_repeats(spark):
    df = spark.createDataFrame([("x", 1, 3, "p"), ("x", 1, 3, "q"), ("x", 4, 4, None), ("x", 6, 9, "p")], "kind string, s int, e int, __k string")
    got = sorted(map(tuple, merge_intervals(df.withColumnRenamed("kind", "who"), "who", "s", "e").collect()))
    assert got == [("x", "gap", 5, 5), ("x", "period", 1, 4), ("x", "period", 6, 9)]


@pytest.mark.parametrize(
    "start, end, months",
    [
        ("Jan 2021", "Present", (24252, 24320)), ("01/2021", "03/2023", (24252, 24278)), ("2020", "2020", (24240, 24251)), ("27/07/2000 until Dec-00", None, (24006, 24011)), ("marzo de 2010", "Juni 2011", (24122, 24137)),
        ("Since August 2022", None, (24271, 24320)), ("from 2020 onwards", "", (24240, 24320)), ("JUNE, 1990", "Jun '91", (23885, 23897)), ("21 Dec 2009", "2010-01-05", (24119, 24120)), ("TBD", "n/a", (None, None)), ("", None, (None, None)), (None, None, (None, None)), ("??/????", "Present", (None, 24320)),
    ],
)
def test_written_dates(spark, start, end, months):
    df = spark.createDataFrame([(start, end)], "a string, b string")
    assert tuple(df.select(written_period(df.a, df.b, 24320).alias("p")).first()["p"]) == months


def test_impossible_dates(spark):
    df = spark.createDataFrame([("13/2020", "2020-00"), ("x" * 100_000, "31/12/2020")], "a string, b string")
    assert [tuple(r["p"]) for r in df.select(month_indexes(df.a, df.b).alias("p")).collect()] == [(None, None), (None, 24251)]


def test_merged_months_golden(spark):
    df = spark.createDataFrame([(1, 0, 11), (1, 10, 19), (1, 20, 24), (1, 30, 39), (2, 5, 5)], "id int, s int, e int")
    assert {tuple(r) for r in merged_months(df, ["id"], "s", "e").collect()} == {(1, 35), (2, 1)}
    assert merged_months(df.limit(0), ["id"], "s", "e").count() == 0
