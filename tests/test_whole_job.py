"""Queries over all adverts, whatever their ids."""

import pytest

from vitaeflow.operators import pairs as A
from vitaeflow.plans import bulk_queries, match_queries

ADS = {100: "Requirements\nPython, SQL\nMinimum 4 years of experience", 101: "Requirements\nPython", 7: "Requirements\nDocker\nNice to have\nSQL", -3: "Requirements\nGo", 205: "About us\nCakes"}
RESUMES = {1: "Jane Doe\nSkills: Python, SQL", 2: "John Roe\nSkills: Docker", 3: "nothing", 4: "Skills: SQL, Go"}
#: The pairs that share a wanted skill.
PAIRS = {(1, 100), (4, 100), (1, 101), (2, 7), (1, 7), (4, 7), (4, -3)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "job_ad") for i, t in ADS.items()] + [(i, t, "resume") for i, t in RESUMES.items()] + [(101, ADS[101], "job_ad"), (None, ADS[101], "job_ad"), (8, None, "job_ad")]
    spark.createDataFrame(rows, "doc_id long, text string, doc_kind string").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([("skill", s, "x") for s in ("Python", "SQL", "Docker", "Go")], "kind string, canonical string, category string").write.parquet(d + "/reference_values.parquet")
    return d


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several blocks of adverts, and few pairs at once."""
    monkeypatch.setattr(A, "ADVERT_BLOCK", 2)
    monkeypatch.setattr(A, "CELLS", 3)


def test_bulk_scores_rank_for_every_advert(spark, folder):
    got = bulk_queries.bulk_scores(spark, folder).collect()
    assert sorted((r["doc_id"], r["job_id"]) for r in got) == sorted(PAIRS)
    assert all(sorted(r["rank"] for r in got if r["job_id"] == j) == list(range(1, 1 + sum(p[1] == j for p in PAIRS))) for j in ADS)


def test_match_scores_of_every_advert(spark, folder):
    got = bulk_queries.match_scores(spark, folder).collect()
    assert sorted((r["doc_id"], r["job_id"]) for r in got) == sorted(PAIRS)
    assert {(r["doc_id"], r["job_id"]): r["skill"] for r in got}[(4, 7)] == 0.2


def test_application_semantic_of_every_advert(spark, folder):
    got = match_queries.application_semantic(spark, folder).collect()
    assert sorted((r["doc_id"], r["job_id"]) for r in got) == sorted(PAIRS)


def test_application_sentences_of_every_advert(spark, folder):
    got = match_queries.application_sentences(spark, folder).collect()
    assert {(r["doc_id"], r["job_id"]) for r in got} == PAIRS
