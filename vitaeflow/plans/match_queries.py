"""Queries that compare, rank and group."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaeflow.functions.phrases import holds_sql, spaced_sql
from vitaeflow.operators import matching as M
from vitaeflow.operators import pairs as A
from vitaeflow.operators import profile as P
from vitaeflow.operators import sentences as N
from vitaeflow.operators import similarity as V
from vitaeflow.operators import skills as S
from vitaeflow.operators import text as X
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.plans.profile_queries import TODAY_YEAR, _doc_lines
from vitaeflow.plans.text_queries import _DOCS, _LINES, _TOKENS, _mentions, _taxonomy, docs
from vitaeflow.sources.scratch import broadcaster, cut_lineage, spread_out
from vitaeflow.sources.tables import latest_by_key, read_table


def _clauses(spark, d):
    """The clauses of job adverts with their parts."""
    ads = read_table(spark, d, "documents").where("doc_kind = 'job_ad'").select("doc_id").distinct()
    return M.job_lines(_doc_lines(spark, d).join(ads, "doc_id", "left_semi"), "doc_id")


def job_parts(spark, d):
    """Clauses of job adverts by part."""
    return _clauses(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("clause").cast("bigint").alias("clause"), "part")


def job_families(spark, d):
    ads = read_table(spark, d, "documents").where("doc_kind = 'job_ad'").groupBy("doc_id").agg(F.min("text").alias("text"))
    return ads.select("doc_id", M.job_family(F.left("text", F.lit(300))).alias("family"))


def _skill_sets(spark, d):
    s = S.skills_of(_mentions(spark, d, False), "doc_id", guarded=False)
    return s.groupBy("doc_id").agg(F.array_sort(F.collect_set("canonical")).alias("skills"))


def _jobs(spark, d, clauses=None):
    """The required and preferred skills of each job advert, or of those whose clauses are given."""
    c = (_clauses(spark, d) if clauses is None else clauses).select(F.struct("doc_id", "part").alias("k"), "line")
    m = S.surfaces_in(c, "k", "line", _taxonomy(spark, d, False)).select("k.doc_id", "k.part", "canonical")
    one = m.groupBy("doc_id").agg(F.collect_set(F.when(F.col("part") == "required", F.col("canonical"))).alias("required"), F.collect_set(F.when(F.col("part") == "preferred", F.col("canonical"))).alias("p"))
    return one.select(F.col("doc_id").alias("job_id"), "required", F.array_except("p", "required").alias("preferred"))


def job_requirements(spark, d):
    return _jobs(spark, d).select("job_id", F.array_join(F.array_sort("required"), ";").alias("required"), F.array_join(F.array_sort("preferred"), ";").alias("preferred"))


def _applications(spark, d):
    """Every resume against the adverts that ask for a skill it has: they meet on skills, never all with all."""
    jobs = _jobs(spark, d)
    resumes = read_table(spark, d, "documents").where("doc_kind = 'resume'").select("doc_id").distinct()
    held = _skill_sets(spark, d).join(resumes, "doc_id", "left_semi")
    # The query set: adverts whose id is divisible by 100, against all resumes.
    wanted = jobs.where("job_id % 100 = 0").select("job_id", F.explode(F.concat("required", "preferred")).alias("skill"))
    met = held.select("doc_id", F.explode("skills").alias("skill")).join(wanted, "skill").select("doc_id", "job_id").distinct()
    return met.join(held, "doc_id").join(jobs, "job_id")


def skill_gap(spark, d):
    a = _applications(spark, d).select("doc_id", "job_id", M.gaps(F.col("skills"), F.col("required")).alias("r"), M.gaps(F.col("skills"), F.col("preferred")).alias("p"))
    return a.select("doc_id", "job_id", F.array_join("r.matched", ";").alias("required_matched"), F.array_join("r.missing", ";").alias("required_missing"), F.array_join(M.recommendations(F.col("r.missing"), F.col("p.missing")), ";").alias("recommended"))


def coverage_plain(spark, d):
    return _applications(spark, d).select("doc_id", "job_id", M.coverage(F.col("skills"), F.col("required"), F.col("preferred")).alias("coverage"))


def _of_kind(spark, d, kind, where="true"):
    """``doc_id, text`` of the documents of one kind, each key once."""
    return one_per_key(read_table(spark, d, "documents").where((F.col("doc_kind") == kind) & F.col("doc_id").isNotNull()).where(where).select("doc_id", "text"), "doc_id")


def _asking_jobs(spark, d, ads):
    """Those of ``ads`` (``doc_id, text``) that ask for a skill: ``job_id, required, preferred``."""
    jobs = _jobs(spark, d, M.job_lines(X.lines_of(ads, "doc_id", "text"), "doc_id"))
    return cut_lineage(jobs.where("size(required) + size(preferred) > 0"))


def _query_jobs(spark, d):
    """The same of the query set of ``_applications``: adverts whose id is divisible by 100."""
    return _asking_jobs(spark, d, _of_kind(spark, d, "job_ad", "doc_id % 100 = 0"))


def _weighted_sets(skills):
    """``doc_id, skills, weights`` out of ``doc_id, skill, weight``, spread over the cores."""
    held = skills.groupBy("doc_id").agg(F.collect_list(F.struct("skill", "weight")).alias("held"))
    return spread_out(cut_lineage(held.select("doc_id", F.col("held.skill").alias("skills"), F.col("held.weight").alias("weights"))))


def _evident_sets(spark, d):
    """The skills of each resume, each by the evidence for it."""
    t = _of_kind(spark, d, "resume")
    e = P.strongest_evidence(S.surfaces_in(t, "doc_id", "text", _taxonomy(spark, d, False)), X.lines_of(t, "doc_id", "text"), "doc_id")
    return _weighted_sets(e.select("doc_id", "skill", F.coalesce("multiplier", F.lit(1.0)).alias("weight")))


def _dated_sets(spark, d):
    """The skills of each resume, each by its recency."""
    t = _of_kind(spark, d, "resume")
    entries = P.dated_entries(X.with_sections(X.lines_of(t, "doc_id", "text"), "doc_id"), "doc_id", TODAY_YEAR)
    used = P.last_used(S.surfaces_in(t, "doc_id", "text", _taxonomy(spark, d, False)), entries, "doc_id")
    return _weighted_sets(used.select("doc_id", "skill", P.recency_weight(F.col("last_year"), TODAY_YEAR).alias("weight")))


def coverage_adjusted(spark, d):
    """Coverage where a skill counts by the evidence for it."""
    return A.score_pairs(_evident_sets(spark, d), _query_jobs(spark, d), "doc_id", "job_id", A.Met.weighted_coverage, "coverage")


#: Weight of a wanted skill that a resume doesn't mention, as of an undated one.
UNDATED = 0.5


def recency_group_score(spark, d):
    """The recency of the wanted skills; those a resume doesn't mention count as undated."""
    return A.score_pairs(_dated_sets(spark, d), _query_jobs(spark, d), "doc_id", "job_id", lambda met: met.mean_weight(UNDATED), "score")


def rank_topn(spark, d):
    """The ten best resumes of each advert of the query set."""
    a = _applications(spark, d).withColumn("matched", F.array_intersect("skills", F.concat("required", "preferred")))
    r = a.select("doc_id", "job_id", M.coverage(F.col("skills"), F.col("required"), F.col("preferred")).alias("match_score"), F.size("matched").alias("skills_match_count"), F.lit("analyzed").alias("status"), F.lit(None).cast("int").alias("professional_months"), F.lit(None).cast("int").alias("experience_years"), F.lit(0).alias("freelance_months"), F.lit("").alias("candidate_name"), F.lit("").alias("filename"))
    return M.rank_candidates(r, ["job_id"], "doc_id", 10).select("job_id", "rank", "doc_id", "match_score", "skills_match_count")


def score_all_modes(spark, d):
    """Weighted scores of the label pairs under each preset, with rater columns in the place of components."""
    p = latest_by_key(read_table(spark, d, "pairs_template").select("pair_id", "rater1", "rater2", "rater3", "rater4", "exported_at"), "pair_id", "exported_at")
    unit = lambda c: F.when(F.col(c).between(0, 100), F.col(c) / 100)
    comp = p.select("pair_id", F.coalesce(unit("rater1"), F.lit(0.0)).alias("skill"), unit("rater2").alias("semantic"), unit("rater3").alias("experience"), unit("rater4").alias("education"), unit("rater4").alias("recency"))
    return M.score_all_modes(comp, "pair_id", M.presets_table(spark))


def exact_dedup(spark, d):
    """Every document with the first one of the same text."""
    return V.exact_duplicates(docs(spark, d), "doc_id", "text")


def near_dup_edges(spark, d):
    return V.similar_rows(_fields(spark, d), "entry_id", "raw", 0.95).select("a", "b", "cosine")


def _fields(spark, d):
    e = read_table(spark, d, "education_entry").where("entry_id is not null and raw is not null")
    return e.groupBy("entry_id").agg(F.min("raw").alias("raw"))


def near_dup_groups(spark, d):
    rows = _fields(spark, d)
    return V.connected_groups(rows, V.similar_rows(rows, "entry_id", "raw", 0.95), "entry_id").withColumnRenamed("group", "group_id")


def tfidf_pair_cosine(spark, d):
    """Evaluation passages as pairs of sentences sets: the first sentence against the others, idf fitted within each."""
    s = read_table(spark, d, "eval_items").select("item_id", F.posexplode(F.split("text", r"(?<=[.?!])\s+")).alias("pos", "t"))
    c = s.select("item_id", F.when(F.col("pos") == 0, "l").otherwise("r").alias("side"), F.col("pos").alias("chunk"), "t")
    return V.best_matches(c, "item_id", "side", "chunk", "t", "l", "r").select("item_id", F.round("cosine", 4).alias("cosine"))


def semantic_normalized(spark, d):
    m = tfidf_pair_cosine(spark, d)
    return m.select("item_id", F.round(V.normalize_similarity(F.col("cosine"), 0.0, 0.3), 4).alias("similarity"))


def _best_sentences(pairs, texts):
    """For each sentence chunk of an advert the closest one of the resume; idf fitted over both texts of the pair.

    ``pairs``: doc_id, job_id; ``texts``: doc_id, text."""
    chunks = cut_lineage(texts.select("doc_id", X.sentence_chunks(X.light_clean(F.col("text"))).alias("chunks")))
    side = lambda key, name: pairs.join(chunks.withColumnRenamed("doc_id", key), key).select(F.struct("doc_id", "job_id").alias("pair"), F.lit(name).alias("side"), F.posexplode("chunks").alias("chunk", "t"))
    return V.best_matches(side("job_id", "job").unionByName(side("doc_id", "resume")), "pair", "side", "chunk", "t", "job", "resume")


def _chunks(text):
    """The sentence chunks of a text in lower case."""
    return F.transform(X.sentence_chunks(X.light_clean(text)), F.lower)


def _sentence_sides(spark, d):
    """The resumes that hold a skill and all adverts that ask for one, with their sentence chunks."""
    t = _of_kind(spark, d, "resume")
    skills = S.skills_of(S.surfaces_in(t, "doc_id", "text", _taxonomy(spark, d, False)), "doc_id", guarded=False)
    held = skills.groupBy("doc_id").agg(F.collect_set("canonical").alias("skills"))
    resumes = held.join(t.select("doc_id", _chunks(F.col("text")).alias("chunks")), "doc_id")
    a = _of_kind(spark, d, "job_ad")
    ads = _asking_jobs(spark, d, a).join(a.select(F.col("doc_id").alias("job_id"), _chunks(F.col("text")).alias("chunks")), "job_id")
    return spread_out(cut_lineage(resumes)), cut_lineage(ads)


def application_sentences(spark, d):
    """Each sentence of an advert with the closest one of each resume that applies, over the whole texts; idf fitted over both texts of the pair."""
    return N.best_sentences(*_sentence_sides(spark, d), "doc_id", "job_id")


def application_semantic(spark, d):
    """The semantic score of each application, and on the scale of scores."""
    s = N.sentence_scores(*_sentence_sides(spark, d), "doc_id", "job_id")
    return s.withColumn("similarity", F.round(V.normalize_similarity(F.col("score"), 0.2, 0.65), 4))


def embed_best_match(spark, d):
    """The five nearest vectors of each vector whose id is divisible by 100, among all."""
    v = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5).select("vec_id", "rank", F.round("cosine", 4).alias("cosine"))


def embed_meanpool(spark, d):
    m = V.mean_vectors(read_table(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("dim", "x")).select("label", F.col("dim").cast("bigint").alias("dim"), F.round("x", 4).alias("x"))


def term_suggestions(spark, d):
    """Capitalised words of documents that aren't in the taxonomy, by the number of documents."""
    w = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+[A-Z][A-Za-z]+|[A-Z]{3,})\b"), 1))).alias("term"))
    known = read_table(spark, d, "reference_values").where("kind = 'skill'").select(F.lower("canonical").alias("t"))
    c = w.groupBy(F.lower("term").alias("t")).agg(F.count_distinct("doc_id").alias("n_docs"), F.min("term").alias("display"))
    return c.where("n_docs > 1").join(broadcaster(known)(known), "t", "left_anti").select(F.col("t").alias("term"), "display", "n_docs")


_SETS = f"""WITH {_DOCS}, {_LINES}, {_TOKENS}, ments AS (SELECT g.doc_id, g.line_no, t.skill FROM grams g JOIN tax t USING (surface))"""

_W = """w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9+#]+'), lambda x: NOT list_contains([{stops}], x)) AS w, id FROM chunks)""".replace("{stops}", ", ".join(f"'{x}'" for x in V.STOP_WORDS))
_TFIDF = f"""WITH s AS (SELECT item_id AS doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS id FROM (SELECT item_id, string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM eval_items)),
chunks AS (SELECT * FROM s), {_W},
tt AS (SELECT doc_id, id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
tf AS (SELECT doc_id, id, term, count(*) AS c FROM tt GROUP BY ALL), n AS (SELECT doc_id, count(DISTINCT id) AS n FROM chunks GROUP BY 1), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT tf.*, (1 + ln(c)) * (ln((1 + n.n) / (1.0 + df.df)) + 1) AS x FROM tf JOIN n USING (doc_id) JOIN df USING (doc_id, term)),
u AS (SELECT doc_id, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, id)) AS w FROM x),
dots AS (SELECT a.doc_id, b.id, sum(a.w * b.w) AS c FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.term = b.term WHERE a.id = 0 AND b.id > 0 GROUP BY ALL),
best AS (SELECT item_id, round(coalesce(max(c), 0), 4) AS cosine FROM eval_items LEFT JOIN dots ON item_id = doc_id GROUP BY 1)"""
_CLAUSES = "regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g')"
for _head in M.CLAUSE_HEADS:
    _CLAUSES = f"regexp_replace({_CLAUSES}, '(?i)(\\s)({_head}\\s*[:-])', '\\1' || chr(10) || '\\2', 'g')"
_LISTED = lambda names: "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"
_JOB = f"""{_SETS},
own AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(line, '[(][^()]*[)]\\s*:?\\s*$|^[\\s#*_`•-]+|[\\s*_`:-]+$', '', 'g'), '[^\\p{{L}}\\p{{N}}\'\'’ -]') THEN NULL WHEN h IN {_LISTED(M.REQUIRED_HEADINGS)} THEN 'required' WHEN h IN {_LISTED(M.PREFERRED_HEADINGS)} THEN 'preferred' WHEN h IN {_LISTED(M.OTHER_HEADINGS)} THEN 'other' END AS own
  FROM (SELECT *, trim({spaced_sql("regexp_replace(line, '[(][^()]*[)]\\s*:?\\s*$', '')")}) AS h FROM lines WHERE line <> '')),
parted AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last, coalesce(bool_or(own IN ('required', 'preferred')) OVER (PARTITION BY doc_id), false) AS headed FROM own),
cut AS (SELECT doc_id, line_no, last, headed, CASE WHEN headed THEN [line] ELSE list_filter(list_transform(string_split({_CLAUSES}, chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS cs FROM parted WHERE own IS NULL),
parts AS (SELECT doc_id, line_no, clause, line, CASE WHEN headed THEN coalesce(last, 'other') WHEN {holds_sql("words", M.PREFERRED_WORDS)} THEN 'preferred' ELSE 'required' END AS part FROM (SELECT *, {spaced_sql("line")} AS words FROM (SELECT doc_id, line_no, last, headed, unnest(cs) AS line, generate_subscripts(cs, 1) AS clause FROM cut))),
ctok AS (SELECT doc_id, part, list_transform(regexp_extract_all(line, '[A-Za-z0-9+#&]+(?:[./''-][A-Za-z0-9+#]+)*'), lambda x: lower(x)) AS t FROM parts),
cgram AS (SELECT doc_id, part, array_to_string(t[pos:pos + n - 1], ' ') AS surface FROM (SELECT *, unnest(generate_series(1, len(t))) AS pos FROM ctok), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE pos + n - 1 <= len(t)),
cment AS (SELECT doc_id, part, skill FROM cgram JOIN tax USING (surface)),
ads AS (SELECT DISTINCT doc_id FROM documents WHERE doc_kind = 'job_ad'), res AS (SELECT DISTINCT doc_id FROM documents WHERE doc_kind = 'resume'),
want AS (SELECT doc_id AS job_id, skill, bool_or(part = 'required') AS req FROM cment WHERE doc_id IN (FROM ads) AND part <> 'other' GROUP BY ALL),
jobs AS (SELECT job_id, list_sort(coalesce(list(skill) FILTER (req), [])) AS required, list_sort(coalesce(list(skill) FILTER (NOT req), [])) AS preferred FROM want GROUP BY 1),
held AS (SELECT doc_id, list_sort(list(DISTINCT skill)) AS skills FROM ments WHERE doc_id IN (FROM res) GROUP BY 1),
app AS (SELECT * FROM held, jobs WHERE job_id % 100 = 0 AND list_has_any(skills, list_concat(required, preferred))),
cov AS (SELECT *, list_filter(required, lambda x: list_contains(skills, x)) AS rm, list_filter(required, lambda x: NOT list_contains(skills, x)) AS rx, list_filter(preferred, lambda x: list_contains(skills, x)) AS pm, list_filter(preferred, lambda x: NOT list_contains(skills, x)) AS px FROM app),
sc AS (SELECT *, round(CASE WHEN len(required) > 0 AND len(preferred) > 0 THEN 0.8::DOUBLE * (len(rm)::DOUBLE / len(required)) + 0.2::DOUBLE * (len(pm)::DOUBLE / len(preferred)) WHEN len(required) > 0 THEN len(rm)::DOUBLE / len(required) WHEN len(preferred) > 0 THEN len(pm)::DOUBLE / len(preferred) ELSE 0 END, 4) AS coverage FROM cov)"""

SQL = {
    "job_parts": _JOB + " SELECT doc_id, line_no, clause, part FROM parts WHERE doc_id IN (FROM ads)",
    "job_families": f"WITH a AS (SELECT doc_id, {spaced_sql('left(any_value(text), 300)')} AS t FROM documents WHERE doc_kind = 'job_ad' GROUP BY 1) SELECT doc_id, CASE " + " ".join(f"WHEN {holds_sql('t', words)} THEN '{n}'" for n, words in M.FAMILIES.items()) + " END AS family FROM a",
    "skill_gap": _JOB + " SELECT doc_id, job_id, array_to_string(rm, ';') AS required_matched, array_to_string(rx, ';') AS required_missing, array_to_string(list_concat(rx, px)[1:10], ';') AS recommended FROM sc",
    "coverage_plain": _JOB + " SELECT doc_id, job_id, coverage FROM sc",
    "rank_topn": _JOB + ", r AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY coverage DESC, len(rm) + len(pm) DESC, doc_id) AS rank, doc_id, coverage AS match_score, len(rm) + len(pm) AS skills_match_count FROM sc) SELECT * FROM r WHERE rank <= 10",
    "score_all_modes": "WITH p AS (SELECT pair_id, any_value(rater1) AS a, any_value(rater2) AS b, any_value(rater3) AS c, any_value(rater4) AS d FROM pairs_template GROUP BY 1), q AS (SELECT pair_id, coalesce(CASE WHEN a BETWEEN 0 AND 100 THEN a / 100 END, 0) AS a, CASE WHEN b BETWEEN 0 AND 100 THEN b / 100 END AS b, coalesce(CASE WHEN c BETWEEN 0 AND 100 THEN c / 100 END, 0) AS c, coalesce(CASE WHEN d BETWEEN 0 AND 100 THEN d / 100 END, 0) AS d FROM p), m(mode, ws, wm, we, wd, wr) AS (VALUES "
    + ", ".join(f"('{k}', {v['skill']}::DOUBLE, {v['semantic']}::DOUBLE, {v['experience']}::DOUBLE, {v['education']}::DOUBLE, {v['recency']}::DOUBLE)" for k, v in M.PRESETS.items())
    + ") SELECT pair_id, mode, least(greatest(round(CASE WHEN b IS NULL THEN a ELSE round(ws * a, 4) + round(wm * b, 4) + round(we * c, 4) + round(wd * d, 4) + round(wr * d, 4) END, 4), 0), 1) AS score FROM q, m",
    "exact_dedup": f"WITH {_DOCS}, f AS (SELECT text, min(doc_id) AS first_key FROM docs WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, first_key, doc_id = first_key AS is_first FROM docs JOIN f USING (text)",
    "near_dup_edges": """WITH e AS (SELECT entry_id AS k, any_value(raw) AS t FROM education_entry WHERE entry_id IS NOT NULL AND raw IS NOT NULL GROUP BY 1), f AS (SELECT t, min(k) AS k FROM e GROUP BY 1),
w AS (SELECT k, unnest(list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9+#]+'), lambda x: NOT list_contains([{stops}], x))) AS term FROM f), tf AS (SELECT k, term, count(*) AS c FROM w GROUP BY ALL),
n AS (SELECT count(*) AS n FROM f), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT k, tf.term, (1 + ln(c)) * (ln((1 + n) / (1.0 + df)) + 1) AS x FROM tf JOIN df USING (term), n), u AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM x)
SELECT a, b, cosine FROM (SELECT p.k AS a, q.k AS b, round(sum(p.w * q.w), 6) AS cosine FROM u p JOIN u q ON p.term = q.term AND p.k < q.k GROUP BY ALL) WHERE cosine >= 0.95 UNION ALL SELECT f.k, e.k, 1.0 FROM e JOIN f USING (t) WHERE e.k <> f.k""".replace("{stops}", ", ".join(f"'{x}'" for x in V.STOP_WORDS)),
    "tfidf_pair_cosine": _TFIDF + " SELECT item_id, cosine FROM best",
    "semantic_normalized": _TFIDF + " SELECT item_id, round(least(greatest((cosine - 0.0) / 0.3, 0), 1), 4) AS similarity FROM best",
    "embed_best_match": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id, r.vec_id AS o, round(list_cosine_similarity(q.e, r.e), 6) AS c FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0), k AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, o) AS rank, round(c, 4) AS cosine FROM p) SELECT * FROM k WHERE rank <= 5",
    "embed_meanpool": "WITH x AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY ALL) SELECT label, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS x FROM m",
    "term_suggestions": f"WITH {_DOCS}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]+[A-Z][A-Za-z]+|[A-Z]{{3,}})\\b')) AS term FROM docs) SELECT lower(term) AS term, min(term) AS display, count(DISTINCT doc_id) AS n_docs FROM w WHERE lower(term) NOT IN (SELECT lower(canonical) FROM reference_values WHERE kind = 'skill') GROUP BY lower(term) HAVING count(DISTINCT doc_id) > 1",
    "job_requirements": _JOB + " SELECT job_id, array_to_string(required, ';') AS required, array_to_string(preferred, ';') AS preferred FROM jobs UNION ALL SELECT doc_id, '', '' FROM (SELECT DISTINCT doc_id FROM cment WHERE doc_id IN (FROM ads) AND doc_id NOT IN (SELECT job_id FROM jobs))",
}

SQL["near_dup_groups"] = f"""WITH RECURSIVE links AS ({SQL["near_dup_edges"]}), ends AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), nodes AS (SELECT DISTINCT entry_id AS k FROM education_entry WHERE entry_id IS NOT NULL AND raw IS NOT NULL),
reached AS (SELECT k AS u, k AS v FROM nodes UNION SELECT reached.u, ends.v FROM reached JOIN ends ON reached.v = ends.u) SELECT u AS entry_id, min(v) AS group_id FROM reached GROUP BY 1"""

QUERIES = {f.__name__: f for f in (job_parts, job_families, job_requirements, skill_gap, coverage_plain, coverage_adjusted, recency_group_score, rank_topn, score_all_modes, exact_dedup, near_dup_edges, near_dup_groups, tfidf_pair_cosine, semantic_normalized, application_sentences, application_semantic, embed_best_match, embed_meanpool, term_suggestions)}
