import random

import pytest

from vitaeflow.operators.packed import CodeBook, candidate_parses, cheapest_parse, fit_code_book, split_packed

BOOK = CodeBook({k: 100 for k in ("unit testing", "code review", "audit & controls", "key/value stores", "tables, views and joins", "backup and restore", "ferrolang", "mentoring", "lint/format rules")}, 900)


@pytest.mark.parametrize(
    "cell, values",
    [
        ("unit testing; code review;mentoring", ["unit testing", "code review", "mentoring"]), ('["unit testing", "\\u00f3strado", "audit & controls"]', ["unit testing", "óstrado", "audit & controls"]), ("['unit testing', \"men's work\"]", ["unit testing", "men's work"]),
        ('ferrolang,"tables, views and joins",code review', ["ferrolang", "tables, views and joins", "code review"]), ("{ferrolang,mentoring}", ["ferrolang", "mentoring"]), ("- ferrolang\n- mentoring*", ["ferrolang", "mentoring*"]), ("1. ferrolang 2. code review", ["ferrolang", "code review"]),
        ("(1) ferrolang (2) mentoring", ["ferrolang", "mentoring"]), ("• ferrolang • mentoring", ["ferrolang", "mentoring"]), ("key/value stores / ferrolang", ["key/value stores", "ferrolang"]), ("key/value stroes", ["key/value stroes"]), ("audit & contrls", ["audit & contrls"]),
        ("ferrolang, mentoring and code review", ["ferrolang", "mentoring", "code review"]), ("backup and restore and ferrolang", ["backup and restore", "ferrolang"]), (";ferrolang;; mentoring ;", ["ferrolang", "mentoring"]), ("ferrolang|", ["ferrolang"]), ("ferrolang, unit testing; mentoring | code review", ["ferrolang", "unit testing", "mentoring", "code review"]),
        ("", []), ("   ", []), (";;", []), ("ferrolang\tferrolang", ["ferrolang", "ferrolang"]), ('"say ""hi"" now", ferrolang', ['say "hi" now', "ferrolang"]),
    ],
)
def test_dialects(cell, values):
    assert cheapest_parse(cell, BOOK)[1] == values


def test_long_cells():
    cell = "; ".join(["ferrolang", "key/value stores"] * 20_000)
    assert len(cheapest_parse(cell, BOOK)[1]) == 40_000
    assert candidate_parses("x" * 500_000)[0][1] == ["x" * 500_000]


def test_split_keeps_rows_and_other_columns(spark):
    rows = [(1, "ferrolang;mentoring;code review", "p"), (1, "ferrolang;mentoring;code review", "p"), (2, None, None), (None, "", "q"), (3, "mentoring;ferrolang", "r")]
    df = spark.createDataFrame(rows, "id int, items string, value string")
    book = fit_code_book(df, "items")
    assert book.total > 0 and "mentoring" in book.counts
    out = {(r["id"], r["value"]): r["parts"] for r in split_packed(df, "items", "parts", book).collect()}
    assert out[1, "p"] == ["ferrolang", "mentoring", "code review"] and out[2, None] is None and out[None, "q"] == []
    assert split_packed(df, "items", "value", book).columns == ["id", "items", "value"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, cell string")
    book = fit_code_book(df, "cell")
    assert book.total == 0 and split_packed(df, "cell", "items", book).count() == 0


def test_unrelated_cells_change_nothing(spark):
    rng = random.Random(6)
    names = ["unit testing", "code review", "audit & controls", "key/value stores", "tables, views and joins", "backup and restore", "ferrolang", "mentoring", "tandem basic", "edge caching"]
    quoted = lambda v: f'"{v}"' if "," in v else v
    cells = [rng.choice([";", ", ", " | ", "\n"]).join(quoted(v) for v in rng.sample(names, rng.randrange(2, 6))) for _ in range(300)]
    other = ["; ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(4)) for _ in range(3000)]
    frame = lambda rows: spark.createDataFrame([(c,) for c in rows], "cell string")
    split = lambda book: [cheapest_parse(c, book)[1] for c in cells]
    alone, grown = fit_code_book(frame(cells), "cell"), fit_code_book(frame(cells + other), "cell")
    assert split(alone) == split(grown)
    assert all(set(values) <= set(names) for values in split(alone))


def test_compounds_are_found_by_their_segments():
    book = CodeBook({k: 100 for k in ("key/value stores", "audit & controls")}, 300)
    near = lambda v: bool(list(book._near(v)))
    assert near("key/valeu stores") and near("controls & audit") and near("ky/value storess basic") and not near("unit/testing") and not near("x" * 50_000)
