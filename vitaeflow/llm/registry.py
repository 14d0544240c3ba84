"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.byte_bpe import encode_texts, public_vocabulary
from vitaeflow.llm.canonical import map_to_canonical
from vitaeflow.llm.consensus import consensus
from vitaeflow.llm.leakage import find_leaks
from vitaeflow.llm.near_duplicates import duplicate_pairs, near_duplicates
from vitaeflow.llm.personal_data import detect, learn_given_names, pseudonymise, with_surrogates
from vitaeflow.llm.spam_pages import score_pages
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.operators.joins import join_lookup
from vitaeflow.plans.packed_skills import split_packed_column
from vitaeflow.sources.scratch import broadcaster, cut_lineage
from vitaeflow.sources.tables import latest_by_key, read_table


def free_values(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, row_key, pos, raw``: every non-empty value of the three columns, each key once."""
    cells = split_packed_column(spark, folder, "skill_eval_template", "true_skills", "labelled_at")
    skills = cells.select(F.lit("skill").alias("kind"), F.col("resume_id").alias("row_key"), F.posexplode("items").alias("pos", "raw"))
    parts = [skills.withColumn("pos", (F.col("pos") + 1).cast("int"))]
    for kind, table, column in (("field", "education_entry", "field"), ("title", "experience_entry", "title")):
        t = latest_by_key(read_table(spark, folder, table).select("entry_id", F.col(column).alias("raw"), "loaded_at"), "entry_id", "loaded_at")
        parts.append(t.select(F.lit(kind).alias("kind"), F.col("entry_id").cast("string").alias("row_key"), F.lit(0).alias("pos"), "raw"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length(F.trim("raw")) > 0)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, row_key, pos, ref_id`` of every value that isn't an entry of its kind as it stands; 0: none fits."""
    refs = read_table(spark, folder, "reference_values")
    names = refs.select("kind", F.col("canonical").alias("raw")).distinct()
    values = cut_lineage(free_values(spark, folder).join(broadcaster(names)(names), ["kind", "raw"], "left_anti"))
    counts = values.groupBy("kind", "raw").agg(F.count("*").alias("n"))
    entries = cut_lineage(map_to_canonical(values, refs).join(counts, ["kind", "raw"]))
    return join_lookup(values, entries, ["kind", "raw"], "n").select("kind", "row_key", "pos", "ref_id")


def _surrogate_key(spark: SparkSession) -> str:
    """The session's ``spark.vitaeflow.surrogate.key``. Where it names none, a fresh key that holds for this run only and is kept nowhere."""
    return spark.conf.get("spark.vitaeflow.surrogate.key", None) or token_hex(32)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, row_key, pii_type, pii_value``, distinct: personal data in requests and in label values, as they are given surrogates."""
    texts, labels = read_table(spark, folder, "anonymize_request"), read_table(spark, folder, "pii_labels_template")
    given = learn_given_names(texts, "resume_text")
    parts = [
        detect(df, key, column, given, whole).withColumn("field_name", F.lit(column))
        for df, key, column, whole in ((texts, "request_id", "resume_text", False), (labels, "label_id", "pii_value", True))
    ]
    found = with_surrogates(cut_lineage(parts[0].unionByName(parts[1])), _surrogate_key(spark))
    return found.where("surrogate is not null").select("field_name", "row_key", "pii_type", "pii_value").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id, redacted, pseudonymised, n_found`` of every request, each key once."""
    texts = read_table(spark, folder, "anonymize_request").select("request_id", "resume_text")
    given = learn_given_names(texts, "resume_text")
    return pseudonymise(one_per_key(texts, "request_id"), "request_id", "resume_text", _surrogate_key(spark), given)


RATERS = ["rater1", "rater2", "rater3", "rater4"]


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = latest_by_key(read_table(spark, folder, "pairs_template").select("pair_id", "panel_id", *RATERS, "exported_at"), "pair_id", "exported_at")
    return consensus(pairs, "pair_id", "panel_id", RATERS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """``pair_id, band`` of each pair with at least two ratings within 0-100."""
    return _consensus(spark, folder)[0].select("pair_id", "band")


def p6_people(spark: SparkSession, folder: str) -> DataFrame:
    """``panel_id, rater, n_ratings, skill, accuracy``: the reliability of each person."""
    return _consensus(spark, folder)[1].select(F.col("panel").alias("panel_id"), F.concat(F.lit("rater"), F.col("r") + 1).alias("rater"), "n_ratings", F.round("skill", 6).alias("skill"), F.round("accuracy", 6).alias("accuracy"))


def p6_panels(spark: SparkSession, folder: str) -> DataFrame:
    """``panel_id, agreement``: mean agreement of two people, corrected for chance."""
    return _consensus(spark, folder)[2].select(F.col("panel").alias("panel_id"), F.round("agreement", 6).alias("agreement"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id_a, request_id_b``: two requests that share at least three quarters of their words."""
    pairs = duplicate_pairs(*near_duplicates(read_table(spark, folder, "role_recommend_request"), "request_id", "resume_text"))
    return pairs.select(F.col("a").alias("request_id_a"), F.col("b").alias("request_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id, class_id, links``: one row per request of 20 words or more, with the class of texts that
    have the same words and the number of other classes it is linked to."""
    members, links = near_duplicates(read_table(spark, folder, "role_recommend_request"), "request_id", "resume_text")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    joined = members.join(ends.groupBy("rep").agg(F.count("*").alias("links")), "rep", "left")
    return joined.select(F.col("id").alias("request_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return encode_texts(read_table(spark, folder, "documents"), "doc_id", "text", public_vocabulary())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, item_id``: documents that hold a stretch of an evaluation item."""
    return find_leaks(read_table(spark, folder, "documents"), "doc_id", "text", read_table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, distinct: documents of which more than half is stuffing."""
    scored = score_pages(read_table(spark, folder, "documents"), "doc_id", "text", "source")
    return scored.where("smoothed > 0.5 and doc_id is not null").select("doc_id").distinct()


def p9_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """``source, n_pages, spam_rate``: mean score of each host's pages, each document once."""
    scored = score_pages(read_table(spark, folder, "documents"), "doc_id", "text", "source").groupBy("doc_id", "host").agg(F.max("score").alias("score"))
    return scored.groupBy(F.col("host").alias("source")).agg(F.count("*").alias("n_pages"), F.round(F.avg("score"), 4).alias("spam_rate"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_redacted": p2_redacted, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_people": p6_people, "p6_panels": p6_panels, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_hosts": p9_hosts}


P5_SQL = r"""WITH d AS (SELECT request_id AS id, any_value(resume_text) AS t FROM role_recommend_request WHERE request_id IS NOT NULL GROUP BY 1),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM d WHERE t IS NOT NULL),
c AS (SELECT id, w, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT id, sum(c) AS n FROM c GROUP BY 1 HAVING sum(c) >= 20),
s AS (SELECT a.id AS x, b.id AS y, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT x AS request_id_a, y AS request_id_b FROM s JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE s >= 0.75 * (a.n + b.n - s)"""


def oracle_sql() -> dict[str, str]:
    """The near duplicates by brute force. The other operators aren't expressible; their tests hold them against brute force,
    public libraries, round trips or known truth."""
    groups = P5_SQL.replace("SELECT x AS request_id_a", ", l AS (SELECT x AS request_id_a").strip() + """),
k AS (SELECT id, n, (SELECT string_agg(w || ' ' || c, ' ' ORDER BY w) FROM c WHERE c.id = n.id) AS bag FROM n), r AS (SELECT id, min(id) OVER (PARTITION BY bag) AS rep FROM k),
e AS (SELECT request_id_a AS u, request_id_b AS v FROM l UNION ALL SELECT request_id_b, request_id_a FROM l)
SELECT r.id AS request_id, r.rep AS class_id, count(DISTINCT o.rep) FILTER (o.rep <> r.rep) AS links FROM r LEFT JOIN e ON e.u = r.rep LEFT JOIN r o ON o.id = e.v GROUP BY r.id, r.rep"""
    return {"p5_found": P5_SQL, "p5_groups": groups}
