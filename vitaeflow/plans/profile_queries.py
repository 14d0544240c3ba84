"""Queries over what a resume says about a person."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaeflow.functions.phrases import holds_sql
from vitaeflow.operators import experience as E
from vitaeflow.operators import profile as P
from vitaeflow.operators import text as X
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.plans.experience_periods import P4_SQL, RUNNING
from vitaeflow.plans.experience_periods import dated_entries as table_entries
from vitaeflow.plans.text_queries import _DOCS, _LINES, _mentions, docs
from vitaeflow.sources.tables import latest_by_key, read_table

TODAY_YEAR = 2026


def _requests(spark, d):
    return one_per_key(read_table(spark, d, "anonymize_request").select("request_id", "resume_text"), "request_id")


def _doc_lines(spark, d):
    return X.lines_of(docs(spark, d), "doc_id", "text")


def emails(spark, d):
    t = _requests(spark, d).select("request_id", F.posexplode(P.emails(F.col("resume_text"))).alias("pos", "email"))
    return t.select("request_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "email")


def contacts(spark, d):
    t = F.col("resume_text")
    return _requests(spark, d).select("request_id", P.first_email(t).alias("email"), P.first_phone(t).alias("phone"), P.links(t).alias("l")).select("request_id", "email", "phone", "l.linkedin", "l.github", "l.other")


def degree_levels(spark, d):
    e = latest_by_key(read_table(spark, d, "education_entry").select("entry_id", "resume_id", "degree", "loaded_at"), "entry_id", "loaded_at")
    return e.groupBy("resume_id").agg(F.max(P.degree_rank(F.col("degree"))).cast("int").alias("degree_rank"), F.count("*").alias("n_entries"))


def education_lines(spark, d):
    return P.education_of(_doc_lines(spark, d), "doc_id").select("doc_id", "degree", "field", "rank")


def experience_phrase_years(spark, d):
    return docs(spark, d).select("doc_id", P.experience_years(F.col("text")).alias("years")).where("years is not null")


def experience_buckets(spark, d):
    e = latest_by_key(read_table(spark, d, "experience_entry").select("entry_id", "raw_text", "loaded_at"), "entry_id", "loaded_at")
    return e.select(P.bucket_of(F.col("raw_text")).alias("b")).groupBy("b.bucket", "b.is_internship").agg(F.count("*").alias("n"))


def interval_merge_months(spark, d):
    t = table_entries(read_table(spark, d, "experience_entry"), kept=("bucket",))
    m = P.merged_months(t.where("resume_id is not null and bucket is not null"), ["resume_id", "bucket"], "s", "e")
    return m.select("resume_id", "bucket", "months", X.duration_text(F.col("months")).alias("duration"))


def experience_totals(spark, d):
    """Months of each resume out of all dates, written ones too."""
    return P.merged_months(table_entries(read_table(spark, d, "experience_entry")).where("resume_id is not null"), ["resume_id"], "s", "e")


def recency_weights(spark, d):
    e = table_entries(read_table(spark, d, "experience_entry")).where("resume_id is not null")
    y = e.groupBy("resume_id").agg(F.max(F.floor(F.col("e") / 12).cast("int")).alias("last_year"))
    return y.select("resume_id", F.coalesce("last_year", F.lit(0)).alias("last_year"), P.recency_weight(F.col("last_year"), TODAY_YEAR).alias("weight"))


def skill_last_used(spark, d):
    lines = X.with_sections(_doc_lines(spark, d), "doc_id")
    u = P.last_used(_mentions(spark, d, False), P.dated_entries(lines, "doc_id", TODAY_YEAR), "doc_id")
    return u.select("doc_id", "skill", "last_year", P.recency_weight(F.col("last_year"), TODAY_YEAR).alias("weight"))


def skill_evidence(spark, d):
    return P.strongest_evidence(_mentions(spark, d, False), _doc_lines(spark, d), "doc_id").select("doc_id", "skill", "level", "multiplier")


def evidence_counts(spark, d):
    e = skill_evidence(spark, d)
    return e.groupBy("doc_id").agg(*[F.count(F.when(F.col("level") == x, 1)).alias(x) for x in P.EVIDENCE_RANK])


def redacted_text(spark, d):
    r = P.redact(F.col("resume_text"))
    return _requests(spark, d).select("request_id", r.alias("redacted"), P.candidate_ref(F.col("resume_text")).alias("ref"))


def redaction_counts(spark, d):
    a = P.redaction_audit(X.lines_of(_requests(spark, d), "request_id", "resume_text"), "request_id")
    return a.groupBy("request_id", "type").agg(F.sum("n").cast("bigint").alias("n"))


def residual_flags(spark, d):
    t = _requests(spark, d).select("request_id", P.redact(F.col("resume_text")).alias("t"))
    return P.residual_flags(X.lines_of(t, "request_id", "t"), "request_id")


def dated_lines(spark, d):
    """Jobs with dates in the lines of documents."""
    e = E.dated_lines(X.with_sections(_doc_lines(spark, d), "doc_id"), "doc_id", RUNNING)
    return e.select("doc_id", "line_no", "range_no", "title", "company", "s", "e", "bucket", "is_internship", "confidence")


def dated_months(spark, d):
    e = E.dated_lines(X.with_sections(_doc_lines(spark, d), "doc_id"), "doc_id", RUNNING)
    return E.months_by_bucket(e, "doc_id")


def head_names(spark, d):
    t = one_per_key(read_table(spark, d, "anonymize_request").select("request_id", "resume_file", "resume_text"), "request_id")
    return t.select("request_id", E.name_in_head(F.col("resume_text"), X.name_from_file(F.col("resume_file"))).alias("name"))


def text_windows(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", E.random_window(F.col("text"), F.col("doc_id")).alias("part"))


_REQ = "docs AS (SELECT request_id AS doc_id, any_value(resume_text) AS text FROM anonymize_request GROUP BY 1)"


def _degree_sql(line: str) -> str:
    """``profile.degree_of`` for DuckDB, out of the same tables."""
    text = f"(' ' || array_to_string(list_transform(regexp_extract_all(lower(translate({line}, '’–—', {chr(39) * 3}--')), '{P._DEGREE_TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: CASE WHEN len(x) - len(replace(x, '.', '')) > 1 THEN x ELSE rtrim(x, '.') END), ' ') || ' ')"
    cases = []
    for level in P.DEGREE_RANKS:
        tests = [holds_sql("x", P._degree_phrases(level))]
        for form in P.DEGREE_SHORT.get(level, ()):
            after = P.DEGREE_FOLLOWERS if level == "Master's" else (*P.DEGREE_FOLLOWERS, ",", *P.DEGREE_FIELDS)
            product = f" AND NOT {holds_sql(f"replace(x, ' {form} in ', ' {form} ')", [f'{form} {w}' for w in P.MS_PRODUCTS])}" if form == "ms" else ""
            tests.append(f"({holds_sql('x', [f'{form} {w}' for w in after])}{product})")
        if level == "Master's":
            tests.append(holds_sql("x", ("bs / ms", "b.s. / m.s.", "b.s / m.s")))
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{level.replace(chr(39), chr(39) * 2)}'")
    return f"list_transform([{text}], lambda x: CASE {' '.join(cases)} END)[1]"


_FIELD = r"nullif(trim(regexp_extract(regexp_extract(line, '\b{0}\s+([A-Z][A-Za-z& ]*)', 1), '^(.*?)(\b(from|at)\b|$)', 1)), '')"
_AFTER_MAIL = f"regexp_replace(line, '{P.EMAIL}', '[EMAIL]', 'g')"
_AFTER_PHONE = f"regexp_replace({_AFTER_MAIL}, '{P.PHONE}', '\\1[PHONE]', 'g')"
_URL = P.URL.replace("'", "''")
_AFTER_LINK = f"regexp_replace({_AFTER_PHONE}, '{_URL}', '\\1[LINK]', 'g')"
_LINKS = f"list_transform(regexp_extract_all(text, '{_URL}', 2), lambda x: regexp_replace(x, '[.,;:)>\\]''\"]+$', ''))"

SQL = {
    "emails": f"""WITH {_REQ}, m AS (SELECT doc_id AS request_id, list_transform(regexp_extract_all(text, '{P.EMAIL}'), lambda x: lower(x)) AS e FROM docs)
SELECT request_id, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS email FROM m""",
    "degree_levels": """WITH e AS (SELECT entry_id, any_value(resume_id) AS resume_id, any_value(lower(degree)) AS g FROM education_entry GROUP BY 1)
SELECT resume_id, CAST(max(CASE WHEN g LIKE 'ph%d%' OR g LIKE 'doctor%' THEN 5 WHEN g LIKE 'master%' OR g LIKE 'mba%' OR g LIKE 'msc%' OR g LIKE 'm.sc%' OR g LIKE 'meng%' THEN 4 WHEN g LIKE 'bachelor%' OR g LIKE 'bsc%' OR g LIKE 'b.sc%' OR g LIKE 'beng%' THEN 3 WHEN g LIKE 'associate%' THEN 2 WHEN g LIKE 'high school%' THEN 1 ELSE 0 END) AS INTEGER) AS degree_rank, count(*) AS n_entries FROM e GROUP BY 1""",
    "experience_buckets": f"""WITH e AS (SELECT entry_id, any_value(lower(coalesce(raw_text, ''))) AS t FROM experience_entry WHERE entry_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in P.FREELANCE)} THEN 'freelance' ELSE 'professional' END AS bucket, {' OR '.join(f"contains(t, '{w}')" for w in P.INTERNSHIP)} AS is_internship, count(*) AS n FROM e GROUP BY 1, 2""",
    "interval_merge_months": P4_SQL.split("good AS")[0].replace("SELECT DISTINCT entry_id, resume_id, date_interval", "SELECT DISTINCT entry_id, resume_id, bucket, date_interval").replace("SELECT entry_id, resume_id, i,", "SELECT entry_id, resume_id, bucket, i,").replace("SELECT DISTINCT x.resume_id,", "SELECT DISTINCT x.resume_id, x.bucket,")
    + """t AS (SELECT * FROM spans WHERE bucket IS NOT NULL AND s IS NOT NULL),
x AS (SELECT DISTINCT resume_id, bucket, unnest(generate_series(s, e)) AS m FROM t WHERE e >= s),
c AS (SELECT resume_id, bucket, CAST(count(*) AS INTEGER) AS months FROM x GROUP BY 1, 2)
SELECT *, concat_ws(' ', CASE WHEN months // 12 > 0 THEN (months // 12) || CASE WHEN months // 12 = 1 THEN ' yr' ELSE ' yrs' END END, CASE WHEN months % 12 > 0 THEN (months % 12) || CASE WHEN months % 12 = 1 THEN ' mo' ELSE ' mos' END END) AS duration FROM c""",
    "experience_totals": P4_SQL.split("seen AS")[0] + """-- months of all dates
x AS (SELECT DISTINCT resume_id, unnest(generate_series(s, e)) AS m FROM good)
SELECT resume_id, CAST(count(*) AS INTEGER) AS months FROM x GROUP BY 1""",
    "recency_weights": P4_SQL.split("good AS")[0] + f"""y AS (SELECT resume_id, max(e // 12) AS y FROM spans GROUP BY 1)
SELECT resume_id, CAST(coalesce(y, 0) AS INTEGER) AS last_year, CASE WHEN y IS NULL THEN 0.5::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.05::DOUBLE, pow(0.5::DOUBLE, greatest({TODAY_YEAR} - y, 0) / 3.0::DOUBLE))), 4) END AS weight FROM y""",
    "redaction_counts": f"""WITH {_REQ}, {_LINES},
n AS (SELECT doc_id AS request_id, len(regexp_extract_all(line, '{P.EMAIL}')) AS email, len(regexp_extract_all({_AFTER_MAIL}, '{P.PHONE}')) AS phone, len(regexp_extract_all({_AFTER_PHONE}, '{_URL}')) AS link,
  CASE WHEN {_degree_sql("line")} IS NOT NULL THEN len(regexp_extract_all({_AFTER_LINK}, '\\b(19|20)[0-9]{{2}}\\b')) ELSE 0 END AS year FROM lines WHERE line <> '')
SELECT request_id, type, CAST(sum(n) AS BIGINT) AS n FROM (UNPIVOT n ON email, phone, link, year INTO NAME type VALUE n) WHERE n > 0 GROUP BY 1, 2""",
    "education_lines": f"""WITH {_DOCS}, {_LINES},
d AS (SELECT doc_id, line_no, line, {_degree_sql("line")} AS degree FROM lines WHERE line <> '' AND lower(trim(regexp_extract(line, '^([^:]*):', 1))) NOT IN ({", ".join(f"'{x}'" for x in P.SKILL_HEADS)})),
f AS (SELECT *, {_FIELD.format("in")} AS i, {_FIELD.format("of")} AS o FROM d WHERE degree IS NOT NULL),
g AS (SELECT doc_id, degree, line_no, coalesce(i, CASE WHEN lower(o) NOT IN ({", ".join(f"'{x}'" for x in P.GENERIC_FIELDS)}) THEN o END) AS field FROM f)
SELECT doc_id, degree, (array_agg(field ORDER BY line_no))[1] AS field, CASE degree {" ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN {v}" for k, v in P.DEGREE_RANKS.items())} END AS rank FROM g GROUP BY 1, 2""",
    "contacts": f"""WITH {_REQ},
x AS (SELECT doc_id AS request_id, list_transform(regexp_extract_all(text, '{P.EMAIL}'), lambda x: lower(x)) AS e, lower(nullif(regexp_replace(regexp_extract(text, '([A-Za-z0-9._%+-]+\\s*@\\s*[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1), '\\s', '', 'g'), '')) AS spaced,
  list_filter(regexp_extract_all(text, '{P.PHONE}', 2), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_full_match(x, '[0-9]{{5}}-?[0-9]{{7}}-?[0-9]')) AS p, {_LINKS} AS l FROM docs)
SELECT request_id, coalesce(e[1], spaced) AS email, p[1] AS phone, list_filter(l, lambda x: contains(lower(x), 'linkedin.com'))[1] AS linkedin, list_filter(l, lambda x: contains(lower(x), 'github.com'))[1] AS github, list_filter(l, lambda x: NOT contains(lower(x), 'linkedin.com') AND NOT contains(lower(x), 'github.com') AND NOT contains(x, '@'))[1] AS other FROM x""",
}

QUERIES = {f.__name__: f for f in (emails, contacts, degree_levels, education_lines, experience_phrase_years, experience_buckets, interval_merge_months, experience_totals, recency_weights, skill_last_used, skill_evidence, evidence_counts, redacted_text, redaction_counts, residual_flags, dated_lines, dated_months, head_names, text_windows)}
