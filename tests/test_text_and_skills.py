import pytest
from pyspark.sql import functions as F

from vitaeflow.operators import skills as S
from vitaeflow.operators import text as X


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[df[f"c{i}"] for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("a  b\t c \r\n=====\r\n\r\n\r\n\r\n“x”…", 'a b c\n\n"x"...'), ("  \n ", None), ("", None), (None, None), ("\x00a\x7f", "a"), ("- item\n* * *", "- item\n* * *")])
def test_light_clean(spark, text, want):
    assert one(spark, X.light_clean, text) == want


def test_nfkc(spark):
    assert one(spark, X.nfkc, "ﬁne①") == "fine1" and one(spark, X.nfkc, None) is None


def brute_chunks(text):
    import re

    out = []
    for line in text.split("\n"):
        line = re.sub(r"^(?:[-*•]|\d{1,2}[.)]|[a-zA-Z]\))\s+", "", re.sub(r"[ \t]+", " ", line).strip(" "))
        for x in re.split(r"(?<=[.!?])\s+", line):
            x = re.sub(r"^[\s\-•*]+|[\s\-•*]+$", "", x)
            if not x:
                continue
            if len(x) >= 15 or not out:
                out.append(x)
            elif len(out[-1]) < 35:
                out[-1] += " " + x
    return out


@pytest.mark.parametrize("text", ["Short. This is a longer sentence here. Ok. Yes.", "- one item of the list\n2) second item, also long enough\nend", "x", "A. B. C. This is much longer than thirty five characters! No."])
def test_sentence_chunks(spark, text):
    assert one(spark, X.sentence_chunks, text) == brute_chunks(text)


def test_sections(spark):
    df = spark.createDataFrame([(1, "Jo\nEXPERIENCE:\nbuilt\n\nEducation\nBSc"), (2, None), (3, "")], "id int, t string")
    rows = [(r["line"], r["section"], r["is_heading"]) for r in X.with_sections(X.lines_of(df, "id", "t"), "id").orderBy("id", "line_no").collect()]
    assert rows == [("Jo", "head", False), ("EXPERIENCE:", "experience", True), ("built", "experience", False), ("Education", "education", True), ("BSc", "education", False)]


@pytest.mark.parametrize("file, name", [("haruto_zellthorn_000000190.pdf", "Haruto Zellthorn"), ("JohnSmith-Resume (1).docx", "John Smith"), ("/in/CV_ana maria.txt", "Ana Maria"), ("000123.pdf", None), ("resume.pdf", None)])
def test_names_from_files(spark, file, name):
    assert one(spark, X.name_from_file, file) == name


@pytest.mark.parametrize("months, text", [(0, "None"), (1, "1 mo"), (12, "1 yr"), (13, "1 yr 1 mo"), (28, "2 yrs 4 mos"), (-3, "None"), (None, "None")])
def test_durations(spark, months, text):
    df = spark.createDataFrame([(months,)], "m int")
    assert df.select(X.duration_text(df.m).alias("x")).first()["x"] == text


def test_title_case(spark):
    assert one(spark, X.title_case, "ci/cd o'neil") == "Ci/Cd O'Neil"


@pytest.mark.parametrize(
    "text, skill, there",
    [
        ("You must be able to code", "backend", False), ("BE Developer wanted", "backend", True), ("We are seeking a Backend Engineer", "backend", False), ("dose of 500 ml", "machine learning", False), ("ML models in use", "machine learning", True), ("noise of 40 dB", "database", False),
        ("DB design", "database", True), ("require fs module", "full stack", False), ("FS developer", "full stack", True), ("a DOM node here", "node.js", False), ("Node and Express", "node.js", True), ("deployment of the API", "api", False), ("REST APIs", "api", True), ("Python and k8s", "kubernetes", True), ("an ai story", "artificial intelligence", False),
    ],
)
def test_guards(spark, text, skill, there):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = {r["canonical"] for r in S.skills_of(S.surfaces_in(df, "id", "t", S.short_forms(spark)), "id").collect()}
    assert (skill in got) == there


def test_taxonomy_file_and_overlaps(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"skills": {"a": {"REST api": {"aliases": ["rest apis"]}, "api": {"aliases": ["apis", "dup"]}}, "b": {"other": {"aliases": ["dup"]}, "c++": {"aliases": []}}}}')
    tax = S.load_taxonomy(spark, str(tmp_path / "t.json"))
    assert {r["surface"]: r["canonical"] for r in tax.collect()} == {"rest api": "rest api", "rest apis": "rest api", "api": "api", "apis": "api", "dup": "other", "other": "other", "c++": "c++"}
    df = spark.createDataFrame([(1, "REST APIs, C++.\nrest\napi"), (2, None), (3, "")], "key int, t string")
    m = S.surfaces_in(df, "key", "t", tax)
    assert sorted((r["line_no"], r["pos"], r["surface"]) for r in m.collect()) == [(1, 1, "rest apis"), (1, 2, "apis"), (1, 3, "c++"), (3, 1, "api")]
    assert S.surfaces_in(df, "key", "t", tax.limit(0)).count() == 0


def test_confidence_and_normalisation(spark):
    assert one(spark, S.mention_confidence, "migrated away from Java in favor of Go", "Java") == "low"
    assert one(spark, S.mention_confidence, "migrated away from Java in favor of Go", "Go") == "high"
    assert one(spark, S.mention_confidence, "Built services in C++ for years", "C++") == "high"
    assert one(spark, S.mention_confidence, "Java is a tool I want to learn", "Java") == "low" and one(spark, S.mention_confidence, "Java", "Go") is None
    assert one(spark, S.mention_confidence, "Java for a very long time in many teams, familiar with Go but", "Java") == "high"
    m = F.create_map(*[F.lit(x) for kv in {"scikit learn": "scikit-learn", "k8s": "kubernetes"}.items() for x in kv])
    assert one(spark, lambda c: S.normalize_skill(c, m), " Scikit-Learn ") == "scikit-learn" and one(spark, lambda c: S.normalize_skill(c, m), "Foo!") == "foo!"
