"""Queries over many resumes and adverts at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaeflow.operators import bulk as B
from vitaeflow.operators import experience as E
from vitaeflow.operators import matching as M
from vitaeflow.operators import metrics as T
from vitaeflow.operators import pairs as A
from vitaeflow.operators import profile as P
from vitaeflow.operators import skills as S
from vitaeflow.operators import text as X
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.plans.eval_queries import _RAT, _SAFE, _ratings
from vitaeflow.plans.experience_periods import RUNNING
from vitaeflow.plans.match_queries import UNDATED, _asking_jobs, _dated_sets, _of_kind
from vitaeflow.plans.text_queries import _taxonomy
from vitaeflow.sources.scratch import cut_lineage, spread_out
from vitaeflow.sources.tables import read_table


def _status(spark, d):
    return B.file_status(one_per_key(read_table(spark, d, "role_recommend_request").select("request_id", "resume_text"), "request_id").where("request_id is not null"), "request_id", "resume_text")


def bulk_status(spark, d):
    """What becomes of each resume that is handed in: analyzed, duplicate of a smaller id, or failed."""
    return _status(spark, d).select("request_id", "status", F.col("first_key").alias("first_id"))


def bulk_summary(spark, d):
    return B.status_counts(_status(spark, d))


def _profiles(spark, d):
    """``doc_id, years, degree_rank, professional_months, freelance_months, name`` of each resume document."""
    t = _of_kind(spark, d, "resume")
    m = E.months_by_bucket(E.dated_lines(X.with_sections(X.lines_of(t, "doc_id", "text"), "doc_id"), "doc_id", RUNNING), "doc_id")
    kinds = m.groupBy("doc_id").agg(*[F.max(F.when(F.col("bucket") == k, F.col("months"))).alias(k) for k in ("professional", "freelance", "full_time", "internship")])
    lines = F.split("text", r"\r\n|\r|\n")
    said = t.select("doc_id", P.experience_years(F.col("text")).alias("said"), F.coalesce(F.array_max(F.transform(lines, P.degree_rank)), F.lit(0)).alias("degree_rank"), E.name_in_head(F.col("text"), F.lit(None).cast("string")).alias("name"))
    return said.join(kinds, "doc_id", "left").select(
        "doc_id", B.candidate_years(F.col("full_time"), F.col("professional"), F.col("internship"), F.col("said")).alias("years"), "degree_rank", F.coalesce("professional", F.lit(0)).alias("professional_months"), F.coalesce("freelance", F.lit(0)).alias("freelance_months"), "name", F.lower(F.coalesce("name", F.lit(""))).alias("low"),
    )


def _candidates(spark, d):
    """The resumes that hold a skill, with their skills, recency and profile."""
    return spread_out(cut_lineage(_dated_sets(spark, d).join(_profiles(spark, d), "doc_id")))


def _asking(spark, d):
    """All adverts that ask for a skill, with what they ask for."""
    ads = _of_kind(spark, d, "job_ad")
    asked = ads.select(F.col("doc_id").alias("job_id"), P.experience_years(F.col("text")).alias("required_years"), P.required_degree_rank(F.col("text")).alias("required_degree"))
    return cut_lineage(_asking_jobs(spark, d, ads).join(asked, "job_id"))


def match_scores(spark, d):
    """Each application with its components by years, degrees, skills and recency, and the composite score without a semantic part, whose weight the others share."""
    return A.match_pairs(_candidates(spark, d), _asking(spark, d), B.rescaled("composite", "semantic"), UNDATED)


def bulk_scores(spark, d):
    """The ten best resumes of each advert by the whole ladder of sort keys: score, matched skills, months of work, freelance months, name, id."""
    best = A.best_pairs(_candidates(spark, d), _asking(spark, d), B.rescaled("composite", "semantic"), UNDATED, 10)
    r = best.withColumns({"status": F.lit("analyzed"), "experience_years": F.lit(None).cast("int"), "filename": F.lit("")})  # years count only where months are null
    return M.rank_candidates(r, ["job_id"], "doc_id", 10).select("job_id", "rank", "doc_id", "match_score", "skills_match_count", "professional_months", "freelance_months", "candidate_name")


def redaction_recall(spark, d):
    """How many labelled values the redacted resumes no longer hold, by type."""
    t = one_per_key(read_table(spark, d, "anonymize_request").select("request_id", "resume_file", "resume_text"), "request_id")
    labels = one_per_key(read_table(spark, d, "pii_labels_template").select("label_id", "resume_file", "pii_type", "pii_value"), "label_id")
    return B.redaction_recall(labels, t.select("resume_file", P.redact(F.col("resume_text")).alias("redacted")), "resume_file", "pii_type", "pii_value", "redacted")


def over_redaction(spark, d):
    """Skills that redaction takes out of resumes: ``request_id, skill``."""
    t = one_per_key(read_table(spark, d, "anonymize_request").select("request_id", "resume_text"), "request_id")
    found = lambda column: S.skills_of(S.surfaces_in(t.select("request_id", column.alias("t")), "request_id", "t", _taxonomy(spark, d)), "request_id").select("request_id", F.col("canonical").alias("skill"))
    return found(F.col("resume_text")).join(found(P.redact(F.col("resume_text"))), ["request_id", "skill"], "left_anti")


RECENCY_WEIGHTS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
_COLUMNS = {"skill": "a", "semantic": "b", "experience": "c", "recency": "e"}


def recency_sweep(spark, d):
    """How well the composite score meets a rating as the weight of recency varies, 0 being the ablation. The label pairs hold ratings only: the
    columns of three raters stand for the components and the first rater's for the judgement."""
    r = _ratings(spark, d).where("rater1 is not null and rater2 is not null and rater3 is not null and rater4 is not null")
    f = r.select("pair_id", (F.col("rater2") / 100).alias("a"), (F.col("rater3") / 100).alias("b"), (F.col("rater4") / 100).alias("c"), (F.col("rater2") / 100).alias("e"), F.col("rater1").alias("h"))
    each = F.array(*[F.struct(F.lit(w).alias("w"), F.round(100 * B.weighted(B.with_weight("composite", "recency", w), _COLUMNS), 4).alias("p")) for w in RECENCY_WEIGHTS])
    return T.correlation(f.select("h", F.inline(each)), "p", "h", ["w"]).select("w", "n", "mae", "pearson", "spearman")


def _sweep_sql(w: float) -> str:
    k = B.with_weight("composite", "recency", w)
    total = " + ".join(f"{k[n]!r}::DOUBLE * {c}" for n, c in (("skill", "a"), ("semantic", "b"), ("experience", "c"), ("recency", "e")))
    return f"SELECT {w!r}::DOUBLE AS w, h, round(100 * least(greatest(0 + {total}, 0), 1), 4) AS p FROM f"


SQL = {
    "bulk_status": "WITH r AS (SELECT request_id, any_value(resume_text) AS t FROM role_recommend_request WHERE request_id IS NOT NULL GROUP BY 1) SELECT request_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'failed' WHEN request_id = min(request_id) OVER (PARTITION BY t) THEN 'analyzed' ELSE 'duplicate' END AS status, CASE WHEN t IS NOT NULL AND trim(t) <> '' THEN min(request_id) OVER (PARTITION BY t) ELSE request_id END AS first_id FROM r",
    "recency_sweep": f"WITH {_RAT}, f AS (SELECT rater2 / 100 AS a, rater3 / 100 AS b, rater4 / 100 AS c, rater2 / 100 AS e, rater1 AS h FROM r WHERE rater1 IS NOT NULL AND rater2 IS NOT NULL AND rater3 IS NOT NULL AND rater4 IS NOT NULL), v AS ("
    + " UNION ALL ".join(map(_sweep_sql, RECENCY_WEIGHTS))
    + "), k AS (SELECT *, rank() OVER (PARTITION BY w ORDER BY p) + (count(*) OVER (PARTITION BY w, p) - 1) / 2.0 AS x, rank() OVER (PARTITION BY w ORDER BY h) + (count(*) OVER (PARTITION BY w, h) - 1) / 2.0 AS y FROM v) "
    + f"SELECT w, count(*) AS n, round(avg(abs(p - h)), 4) AS mae, round({_SAFE.replace('(x', '(p').replace('y)', 'h)')}, 4) AS pearson, round({_SAFE}, 4) AS spearman FROM k GROUP BY 1",
}
SQL["bulk_summary"] = f"WITH s AS ({SQL['bulk_status']}) SELECT status, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM s"

QUERIES = {f.__name__: f for f in (bulk_status, bulk_summary, match_scores, bulk_scores, redaction_recall, over_redaction, recency_sweep)}
