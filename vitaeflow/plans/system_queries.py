"""Queries that join several operators: screening, roles, sessions, table sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaeflow.operators import metrics as M
from vitaeflow.operators import profile as P
from vitaeflow.operators import roles
from vitaeflow.operators import text as X
from vitaeflow.operators.dedup import one_per_key

from vitaeflow.sources.tables import read_table


def screening_profile(spark, d):
    """Each request as one profile row: reference, contact, degree, years, without names."""
    t = one_per_key(read_table(spark, d, "anonymize_request").select("request_id", "resume_text"), "request_id")
    c = F.col("resume_text")
    degrees = F.array_max(F.transform(F.split(c, "\n"), lambda x: P.degree_rank(x)))
    return t.select("request_id", P.candidate_ref(c).alias("ref"), F.coalesce(degrees, F.lit(0)).alias("degree_rank"), P.experience_years(c).alias("years"), F.size(P.emails(c)).alias("n_emails"), F.length(X.light_clean(c)).alias("n_chars"))


def request_hashes(spark, d):
    """The first request of the same text, by content hash."""
    t = read_table(spark, d, "role_recommend_request").where("resume_text is not null").groupBy("request_id").agg(F.min(F.sha2("resume_text", 256)).alias("hash"))
    return t.join(t.groupBy("hash").agg(F.min("request_id").alias("first_id"), F.count("*").alias("copies")), "hash").select("request_id", "hash", "first_id", "copies")


def _titled(spark, d):
    e = read_table(spark, d, "documents").where("doc_kind is not null and text is not null")
    return one_per_key(e.select("doc_id", "text", F.col("doc_kind").alias("kind")), "doc_id")


def role_topk(spark, d):
    """The two most probable kinds of each document, by a model trained on the labelled ones."""
    t = _titled(spark, d)
    return roles.top_roles(roles.train_roles(t, "doc_id", "text", "kind"), t, "doc_id", "text", 2)


def role_report(spark, d):
    """Precision and recall of the kinds on a fold that the model hasn't seen."""
    return M.classification_report(roles.held_out(_titled(spark, d), "doc_id", "text", "kind"), "actual", "predicted")


def role_confusions(spark, d):
    """The five most common mix-ups of kinds on a fold that the model hasn't seen."""
    return M.top_confusions(roles.held_out(_titled(spark, d), "doc_id", "text", "kind"), "actual", "predicted")


def role_uncertainty(spark, d):
    return M.uncertainty(roles.held_out(_titled(spark, d), "doc_id", "text", "kind"), "probability", "actual", "predicted", roles.UNCERTAIN)


def event_days(spark, d):
    """Events by day and type: the batch form of the windowed stream."""
    e = read_table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_sessions(spark, d):
    """Sessions of each user: events no more than a day apart."""
    e = read_table(spark, d, "events").where("user_id is not null and ts is not null")
    s = e.groupBy(F.session_window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def document_facets(spark, d):
    """Documents by language and kind with subtotals."""
    t = read_table(spark, d, "documents").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("doc_kind").alias("kind"), F.min("n_chars").alias("n_chars"))
    r = t.select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("kind", F.lit("-")).alias("kind"), "n_chars").cube("lang", "kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))
    return r.select("lang", "kind", "n", F.col("chars").cast("bigint").alias("chars"), "level")


SQL = {
    "request_hashes": "WITH t AS (SELECT request_id, sha256(any_value(resume_text)) AS hash FROM role_recommend_request WHERE resume_text IS NOT NULL GROUP BY 1) SELECT request_id, hash, min(request_id) OVER (PARTITION BY hash) AS first_id, count(*) OVER (PARTITION BY hash) AS copies FROM t",
    "event_days": "SELECT strftime(ts AT TIME ZONE 'UTC' , '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT ts::TIMESTAMP AT TIME ZONE 'UTC' AS ts, event_type, value FROM events) GROUP BY 1, 2",
    "event_sessions": "WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM e), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g",
    "document_facets": "WITH t AS (SELECT doc_id, coalesce(any_value(lang), '-') AS lang, coalesce(any_value(doc_kind), '-') AS kind, any_value(n_chars) AS n_chars FROM documents GROUP BY 1) SELECT lang, kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping_id(lang, kind) AS INTEGER) AS level FROM t GROUP BY CUBE (lang, kind)",
}

QUERIES = {f.__name__: f for f in (screening_profile, request_hashes, role_topk, role_report, role_confusions, role_uncertainty, event_days, event_sessions, document_facets)}
