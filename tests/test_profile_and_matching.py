import math

import pytest
from pyspark.sql import functions as F

from vitaeflow.operators import layout, matching, metrics, rewrite
from vitaeflow.operators import profile as P
from vitaeflow.operators import similarity as V
from vitaeflow.operators import text as X

from test_text_and_skills import one


@pytest.mark.parametrize("text, phone", [("call +92 300 1234567 now", "+92 300 1234567"), ("CNIC 35202-1234567-1", None), ("2015 - 2018", None), ("tel 020 7946 0519", "020 7946 0519"), (None, None)])
def test_phone(spark, text, phone):
    assert one(spark, P.first_phone, text) == phone


def test_email_and_links(spark):
    assert one(spark, P.first_email, "x Jo@Post.Test y@z.com") == "jo@post.test" and one(spark, P.first_email, "jo @ post.test") == "jo@post.test" and one(spark, P.first_email, "none") is None
    link = one(spark, P.links, "see https://linkedin.com/in/jo, github.com/jo and www.jo.dev.")
    assert (link.linkedin, link.github, link.other) == ("https://linkedin.com/in/jo", "github.com/jo", "www.jo.dev")


@pytest.mark.parametrize("line, level", [("PhD in Law", "PhD"), ("M.Sc. in Physics", "Master's"), ("MS in Excel", "Master's"), ("MS Office", None), ("BSc in Law, X", "Bachelor's"), ("BS Computer Science", "Bachelor's"), ("Associate degree", "Associate"), ("High School Diploma", "High School"), ("plumbing", None), ("Intermediate (Pre-Engineering)", "High School"), ("FSc Pre-Medical", "High School"), ("MS (Data Science)", "Master's"), ("B.S - Physics", "Bachelor's"), ("M. Sc. Physics", "Master's"), ("Ph. D.", "PhD"), ("to be able to", None), ("BS/MS", "Master's"), ("A-Levels", "High School"), ("MS Project in use", None)])
def test_degrees(spark, line, level):
    if line == "MS in Excel":
        level = None  # a tool, not a degree
    assert one(spark, P.degree_of, line) == level


@pytest.mark.parametrize("text, years", [("5+ years of experience", 5), ("0-2 years", 0), ("over 3 years; experience: 7 yrs", 7), ("**Required Experience:** 3 years", 3), ("3-5 yrs", 3), ("4+ years of software engineering experience", 4), ("6 years in Python", 6), ("more than 8 yrs", 8), ("for 9 years. Experience", None), ("none", None), (None, None)])
def test_years(spark, text, years):
    assert one(spark, P.experience_years, text) == years


@pytest.mark.parametrize("year, weight", [(2026, 1.0), (2025, 0.7937), (2024, 0.63), (2022, 0.3969), (2018, 0.1575), (1980, 0.05), (None, 0.5), (2030, 1.0)])
def test_recency(spark, year, weight):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(P.recency_weight(df.y, 2026).alias("w")).first()["w"] == pytest.approx(weight, abs=1e-4)


def test_buckets(spark):
    assert one(spark, P.bucket_of, "Freelance designer").bucket == "freelance"
    assert one(spark, P.bucket_of, "Internal auditor").is_internship and not one(spark, lambda c: P.bucket_of(c, strict=True), "Internal auditor").is_internship


def test_redaction_is_idempotent(spark):
    text = "Jo, jo@post.test, +44 7700 900123, https://jo.dev\nBSc in Law, 2009\nHe told her that her team 2010"
    once = one(spark, P.redact, text)
    assert "@" not in once and "[PHONE]" in once and "[YEAR]" in once and "2010" in once and "They told" in once and "their team" in once
    assert one(spark, P.redact, once) == once and one(spark, P.redact, None) is None
    assert one(spark, P.redact, "She is an engineer. He has skills and he builds APIs himself.") == "They are an engineer. They have skills and they build APIs themselves."
    assert one(spark, P.redact, "She studies; he also was promoted. He reaches goals.") == "They study; they also were promoted. They reach goals." and one(spark, P.redact, "they is fine") == "they is fine"


def test_evidence(spark):
    level = lambda line, listed=False: one(spark, lambda c: P.evidence_level(c, F.lit(listed)), line)
    assert level("Reduced API latency by 40% using Redis.") == "high_depth" and level("Built APIs") == "demonstrated" and level("saved 40%") == "demonstrated" and level("Redis") == "listed" and level("Built 40%", True) == "listed"
    assert level("Successfully migrated data") == "demonstrated" and level("5 years of Java in 2019") == "listed" and level("Shipped $3 million") == "high_depth" and level("planning 12 releases") == "demonstrated"
    assert one(spark, P.metrics_in, "saved $3 million and 40% in 2019, over 5 years, 3x (1,200 users)") == ["$3 million", "40%", "3x", "1,200"]
    assert [one(spark, P.verb_of, w) for w in ("shipped", "analyses", "written", "deployed", "queried", "optimizing", "singing")] == ["ship", "analyse", "write", "deploy", "query", "optimize", None]


@pytest.mark.parametrize("held, req, pref, want", [(["a", "b"], ["a", "b"], ["a"], 1.0), (["a"], ["a", "b", "c"], [], 0.3333), (["x"], ["a"], ["x"], 0.2), ([], ["a"], ["b"], 0.0), (["a"], [], [], 0.0), (["b"], [], ["b", "c"], 0.5)])
def test_coverage(spark, held, req, pref, want):
    df = spark.createDataFrame([(held, req, pref)], "h array<string>, r array<string>, p array<string>")
    assert df.select(matching.coverage(df.h, df.r, df.p).alias("c")).first()["c"] == pytest.approx(want, abs=1e-4)


def test_adjusted_coverage_and_group_score(spark):
    wanted = spark.createDataFrame([(1, 7, "a", True), (1, 7, "b", True), (1, 7, "c", False), (2, 7, "a", True), (3, 7, "c", False)], "doc int, job int, skill string, required boolean")
    held = spark.createDataFrame([(1, "a", 0.5), (1, "c", None), (3, "c", 0.85)], "doc int, skill string, multiplier double")
    got = {r["doc"]: r["coverage"] for r in matching.adjusted_coverage(wanted, held, ["doc", "job"]).collect()}
    assert got == {1: pytest.approx(0.8 * 0.25 + 0.2), 2: 0.0, 3: 0.85}
    w = wanted.withColumn("w", F.when(F.col("skill") == "a", 1.0).otherwise(0.5))
    assert {r["doc"]: r["score"] for r in matching.group_score(w, ["doc"], "w").collect()} == {1: 0.7, 2: 1.0, 3: 0.5}


def test_presets_sum_to_one_and_degrade(spark):
    assert all(math.isclose(sum(p.values()), 1) for p in matching.PRESETS.values())
    df = spark.createDataFrame([(1, 0.5, 1.0, 1.0, 1.0, 1.0), (2, 0.5, None, 1.0, 1.0, 1.0)], "id int, skill double, semantic double, experience double, education double, recency double")
    out = {(r["id"], r["mode"]): r["score"] for r in matching.score_all_modes(df, "id", matching.presets_table(spark)).collect()}
    assert out[1, "hybrid"] == 0.65 and out[1, "skills_only"] == 0.5 and out[2, "composite"] == 0.5


RANK = "status string, match_score double, skills_match_count int, professional_months int, experience_years int, freelance_months int, candidate_name string, filename string, id int"


def test_ranking(spark):
    rows = [("analyzed", 0.5, 2, None, 2, 0, "b", "f", 1), ("analyzed", 0.5, 2, 24, 0, 0, "A", "f", 2), ("analyzed", 0.9, 0, 0, 0, 0, None, "z", 3), ("failed", 1.0, 9, 9, 9, 9, "x", "x", 4), ("analyzed", None, None, None, None, None, None, None, 5), ("analyzed", 0.5, 3, 0, 0, 0, "c", "f", 6)]
    df = spark.createDataFrame(rows, RANK)
    ranked = [r["id"] for r in matching.rank_candidates(df, [], "id").orderBy("rank").collect()]
    assert ranked == [3, 6, 2, 1, 5]
    assert [r["id"] for r in matching.rank_candidates(df, [], "id", 2).orderBy("rank").collect()] == ranked[:2] and matching.rank_candidates(df, [], "id", 99).count() == 5
    for n in (0, -5):
        with pytest.raises(ValueError):
            matching.rank_candidates(df, [], "id", n)


def test_job_parts(spark):
    df = spark.createDataFrame([(1, "Dev\n**Requirements:**\n- Python\nNice to have\n- Go"), (2, "Python is required\nGo is a plus\nSQL")], "id int, t string")
    got = [(r["id"], r["line"], r["part"]) for r in matching.job_lines(X.lines_of(df, "id", "t"), "id").orderBy("id", "line_no").collect()]
    assert got == [(1, "Dev", "other"), (1, "- Python", "required"), (1, "- Go", "preferred"), (2, "Python is required", "required"), (2, "Go is a plus", "preferred"), (2, "SQL", "required")]


def test_correlation_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("c", None, 6.0)], "g string, x double, y double")
    out = {r["g"]: (r["n"], r["mae"], r["pearson"], r["spearman"]) for r in metrics.correlation(df, "x", "y", ["g"]).collect()}
    assert out["b"] == (1, 0.0, 0.0, 0.0) and out["c"][2:] == (0.0, 0.0) and out["a"][2] == pytest.approx(0.866, abs=1e-3) and out["a"][3] == pytest.approx(0.866, abs=1e-3)


def test_prf_golden(spark):
    df = spark.createDataFrame([(129, 22, 0), (0, 0, 0)], "tp int, fp int, fn int")
    out = {r["average"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.prf_micro_macro(df).collect()}
    assert out["micro"] == (0.8543, 1.0, 0.9214) and out["macro"][0] == pytest.approx(0.8543 / 2, abs=1e-3)


@pytest.mark.parametrize("dof, want", [(1, 12.7062), (2, 4.3027), (5, 2.5706), (23, 2.0687), (300, 1.9679)])
def test_student(dof, want):
    assert metrics.student_quantile(0.975, dof) == pytest.approx(want, abs=1e-3)


def test_groups_and_similar_rows(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10)], "a int, b int")
    got = {r["id"]: r["group"] for r in V.connected_groups(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 9, 11: 11}
    rows = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "delta gamma beta alpha"), (4, "other words here entirely"), (5, None), (6, "")], "id int, t string")
    assert {(r["a"], r["b"]) for r in V.similar_rows(rows, "id", "t", 0.95).collect()} == {(1, 2), (1, 3)}


def test_nearest_in_blocks(spark, monkeypatch):
    rows = [(i, [float(math.cos(i)), float(math.sin(i)), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    a = {tuple(r) for r in V.nearest(df.where("id % 7 = 0"), df, "id", "v", 3).collect()}
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    b = {tuple(r) for r in V.nearest(df.where("id % 7 = 0"), df, "id", "v", 3).collect()}
    assert a == b and len(a) == 27


def test_weak_bullets(spark):
    reasons = one(spark, lambda c: rewrite.weak_reasons(c, F.lit(False)), "Responsible for deployment of the API.")
    assert reasons == ["weak_opener:responsible for", "no_metric", "no_skill_mentioned"]
    new = one(spark, rewrite.rewritten, "Responsible for deployment of the API.")
    assert new.startswith("Owned deployment of the API, [") and not any(c.isdigit() for c in new)
    assert one(spark, rewrite.category_of, "deploy the container pipeline to a table") == "devops_tools" and one(spark, rewrite.category_of, "nothing") is None


def test_two_columns(spark):
    blocks = [(1, 50, 20, 550, 60, "head"), (1, 40, 100, 280, 200, "l1"), (1, 40, 300, 280, 400, "l2"), (1, 320, 100, 560, 200, "r1"), (1, 320, 300, 560, 400, "r2"), (2, 40, 100, 560, 120, "a"), (2, 40, 140, 300, 160, "b")]
    df = spark.createDataFrame([(p, float(a), float(b), float(c), float(d), t, 600.0, 800.0) for p, a, b, c, d, t in blocks], "page int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double")
    got = [(r["page"], r["text"]) for r in layout.reading_order(df).orderBy("page", "ord").collect()]
    assert got == [(1, "head"), (1, "l1"), (1, "l2"), (1, "r1"), (1, "r2"), (2, "a"), (2, "b")]
    words = df.withColumnRenamed("text", "word").withColumn("word", F.when(F.col("word") == "l1", "Docker,").otherwise("x"))
    boxes = layout.highlight_boxes(words, spark.createDataFrame([("docker", "preferred"), ("Docker", "unverified")], "skill string, category string")).collect()
    assert len(boxes) == 1 and boxes[0]["category"] == "unverified" and 0 < boxes[0]["bx0"] < boxes[0]["bx1"] <= 1


def test_semantic_score_of_whole_texts_per_pair(spark):
    import re
    from collections import Counter

    from vitaeflow.plans import match_queries, registry

    texts = {
        1: "Built data pipelines with Spark and Python daily.\nLed a team of nurses at night.\nWrote data reports in Python for sales.",
        2: "Cooked meals for large hotel kitchens.\nKept stock of kitchen supplies.",
        7: "We need data pipelines with Spark and Python.\nReports for the sales team are written weekly.",
        8: "Cook meals for hotel kitchens every day.\nUnrelated quantum gravity lecture halls.",
    }
    pairs = [(1, 7), (2, 7), (1, 8), (2, 8)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    m = match_queries._best_sentences(spark.createDataFrame(pairs, "doc_id long, job_id long"), df)
    got = {(r["pair"]["doc_id"], r["pair"]["job_id"]): r["score"] for r in V.semantic_score(m, "pair").collect()}

    def terms(t):
        w = [x for x in re.findall(r"[a-z0-9][a-z0-9+#]+", t.lower()) if x not in V.STOP_WORDS]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    for doc, job in pairs:
        left, right = ([terms(t) for t in texts[i].split("\n")] for i in (job, doc))
        df_of, n = Counter(t for c in left + right for t in c), len(left + right)
        unit = []
        for c in left + right:
            x = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df_of[t])) + 1) for t, k in c.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            unit.append({t: v / norm for t, v in x.items()})
        best = [max(sum(v * r.get(t, 0) for t, v in u.items()) for r in unit[len(left) :]) for u in unit[: len(left)]]
        assert got[doc, job] == pytest.approx(sum(best) / len(best), abs=1e-4)
    assert len(got) == len(pairs) and got[1, 7] > 0.2 and got[2, 7] == 0
    assert {"application_sentences", "application_semantic"} <= set(registry.queries())


def test_top_confusions(spark):
    rows = [("a", "b")] * 3 + [("b", "a")] * 3 + [("a", "a")] * 9 + [("c", "a")] * 5 + [("b", "c"), ("c", "b"), ("a", "c"), (None, "a"), ("a", None)]
    got = [tuple(r) for r in metrics.top_confusions(spark.createDataFrame(rows, "x string, y string"), "x", "y").collect()]
    assert got == [("c", "a", 5), ("a", "b", 3), ("b", "a", 3), ("a", "c", 1), ("b", "c", 1)]


def test_groups_that_have_not_settled_are_told(spark):
    nodes, edges = spark.range(1, 21), spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a long, b long")
    assert {r["group"] for r in V.connected_groups(nodes, edges).collect()} == {1}
    with pytest.raises(ValueError, match="settled"):
        V.connected_groups(nodes, edges, rounds=1)
