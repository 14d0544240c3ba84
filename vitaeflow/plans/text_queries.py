"""Queries over document texts: cleaning, lines, sections, skills."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.functions.phrases import holds_sql, spaced_sql
from vitaeflow.operators import skills as S
from vitaeflow.operators import text as X
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.sources.tables import read_table


def docs(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, text``, each key once."""
    return one_per_key(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def clean_text(spark, d):
    t = docs(spark, d).select("doc_id", X.light_clean(X.nfkc("text")).alias("clean"))
    return t.select("doc_id", "clean", X.preview(F.col("clean"), 120).alias("preview"))


def line_sections(spark, d):
    return X.with_sections(X.lines_of(docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "section", "is_heading")


def sentence_chunks(spark, d):
    t = docs(spark, d).select("doc_id", F.posexplode(X.sentence_chunks(X.light_clean(F.col("text")))).alias("pos", "chunk"))
    return t.select("doc_id", (F.col("pos") + 1).alias("pos"), "chunk")


def _taxonomy(spark, d, short=True):
    own = S.taxonomy_of(read_table(spark, d, "reference_values").where("kind = 'skill'"), "canonical", "category")
    return own.unionByName(S.short_forms(spark)) if short else own


def _mentions(spark, d, short=True):
    return S.surfaces_in(docs(spark, d), "doc_id", "text", _taxonomy(spark, d, short))


def skill_match(spark, d):
    return S.skills_of(_mentions(spark, d, False), "doc_id", guarded=False).select("doc_id", F.col("canonical").alias("skill"), "category", F.col("line_no").cast("bigint").alias("line_no"), F.col("pos").cast("bigint").alias("pos"))


def skill_match_guarded(spark, d):
    return S.skills_of(_mentions(spark, d), "doc_id").select("doc_id", F.col("canonical").alias("skill"))


def skill_match_unguarded(spark, d):
    return S.skills_of(_mentions(spark, d), "doc_id", guarded=False).select("doc_id", F.col("canonical").alias("skill"))


def skill_category_rollup(spark, d):
    s = S.skills_of(_mentions(spark, d, False), "doc_id", guarded=False)
    r = s.rollup("category", "canonical").agg(F.count("*").alias("n_docs"), F.grouping_id().cast("int").alias("level"))
    return r.select("category", F.col("canonical").alias("skill"), "n_docs", "level")


def skill_confidence(spark, d):
    """Mentions by the sentence they stand in; a skill is ``high`` if any mention is."""
    m = _mentions(spark, d, False).select("doc_id", "line_no", "canonical", "raw").distinct()
    lines = X.lines_of(docs(spark, d), "doc_id", "text")
    j = m.join(lines, ["doc_id", "line_no"]).select("doc_id", "canonical", "raw", F.explode(F.split("line", r"(?<=[.!?])\s+")).alias("sentence"))
    c = j.withColumn("confidence", S.mention_confidence(F.col("sentence"), F.col("raw"))).where("confidence is not null")
    return c.groupBy("doc_id", F.col("canonical").alias("skill")).agg(F.min("confidence").alias("confidence"))


def file_names(spark, d):
    t = read_table(spark, d, "anonymize_request").groupBy("request_id").agg(F.min("resume_file").alias("resume_file"))
    return t.select("request_id", X.name_from_file(F.col("resume_file")).alias("candidate_name"))


_DOCS = "docs AS (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id)"
_CLEAN_LINE = r"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '^ | $', '', 'g')"
_LINES = rf"""lines AS (SELECT doc_id, line_no, {_CLEAN_LINE.format(x="l")} AS line FROM (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM docs)))"""
_TOKENS = r"""tokens AS (SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '[A-Za-z0-9+#&]+(?:[./''-][A-Za-z0-9+#]+)*'), lambda x: lower(x)) AS t FROM lines),
grams AS (SELECT doc_id, line_no, pos, array_to_string(t[pos:pos + n - 1], ' ') AS surface FROM (
  SELECT doc_id, line_no, t, unnest(generate_series(1, len(t))) AS pos FROM tokens), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE pos + n - 1 <= len(t)),
tax AS (SELECT array_to_string(regexp_extract_all(lower(canonical), '[A-Za-z0-9+#&]+(?:[./''-][A-Za-z0-9+#]+)*'), ' ') AS surface, lower(canonical) AS skill, category FROM reference_values WHERE kind = 'skill')"""
_SHORT = "short AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.SHORT_FORMS.items()) + ") AS v(surface, skill))"

# By rule: each sign with its compatibility form, where that is another one.
_COMPATIBLE = ", ".join(f"('{chr(c)}', '{n.replace(chr(39), chr(39) * 2)}')" for c in (*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)) if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c))
_NFKC = f"""wide AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM docs WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
narrow AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(v.n, c), '' ORDER BY i)) AS text FROM wide LEFT JOIN (VALUES {_COMPATIBLE}) AS v(k, n) ON v.k = wide.c GROUP BY 1),
composed AS (SELECT doc_id, coalesce(narrow.text, docs.text) AS text FROM docs LEFT JOIN narrow USING (doc_id))"""


def _condition_sql(place: int | str, words: tuple) -> str:
    listed = "(" + ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in words) + ")"
    if place == "as":
        return f"raw IN {listed}"
    if place == "dot":
        return "dot"
    if place == "number":
        return f"(regexp_matches(coalesce(b[-1], ''), '[0-9]') OR coalesce(b[-1], '') IN ({', '.join(repr(w) for w in S.NUMBER_WORDS)}))"
    if isinstance(place, str):
        return "(" + " OR ".join(f"contains(array_to_string({place[0]}, ' '), '{w}')" for w in words) + ")"
    return f"coalesce({'b' if place < 0 else 'a'}[{place}] IN {listed}, false)"


_GUARDED = "CASE " + " ".join("WHEN " + " AND ".join([f"surface IN ({', '.join(repr(x) for x in names)})", *[_condition_sql(*c) for c in conditions.items()]]) + f" THEN {verdict}" for names, verdict, conditions in S.GUARDS) + " ELSE true END"
_NEAR_TOKENS = r"""ends AS (SELECT doc_id, line_no, regexp_extract_all(line, '[A-Za-z0-9+#&]+(?:[./''-][A-Za-z0-9+#]+)*\.?') AS e FROM lines),
tk AS (SELECT doc_id, line_no, e, list_transform(e, lambda x: rtrim(x, '.')) AS r, list_transform(e, lambda x: lower(rtrim(x, '.'))) AS t FROM ends),
near AS (SELECT doc_id, line_no, array_to_string(r[pos:pos + n - 1], ' ') AS raw, array_to_string(t[pos:pos + n - 1], ' ') AS surface, t[greatest(pos - 4, 1):pos - 1] AS b, t[pos + n:pos + n + 3] AS a, ends_with(e[pos + n - 1], '.') AS dot FROM (
  SELECT *, unnest(generate_series(1, len(t))) AS pos FROM tk), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE pos + n - 1 <= len(t))"""
_TURN_SQL, _WEAK_SQL = [f"' {p} '" for p in S.TURNING], [f"' {p} '" for p in S.WEAKENING]
_LAST_TURN = "greatest(0, " + ", ".join(f"CASE WHEN contains(bef, {p}) THEN length(bef) - instr(reverse(bef), reverse({p})) ELSE 0 END" for p in _TURN_SQL) + ")"
_FIRST_TURN = "least(length(aft), " + ", ".join(f"CASE WHEN contains(aft, {p}) THEN instr(aft, {p}) ELSE length(aft) END" for p in _TURN_SQL) + ")"
_SOON = " OR ".join(f"(contains(head, {p}) AND len(string_split(left(head, instr(head, {p}) - 1), ' ')) - 1 <= {S.REACH})" for p in _WEAK_SQL)

SQL = {
    "clean_text": rf"""WITH {_DOCS}, {_NFKC},
a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS t FROM composed),
b AS (SELECT doc_id, replace(translate(t, '‘’“”–—•‣■●', '''''""------'), '…', '...') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[-=*_~#]{{3,}}[ \t]*$')), lambda x: {_CLEAN_LINE.format(x="x")}), chr(10)) AS t FROM b),
e AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '') AS clean FROM c)
SELECT doc_id, clean, CASE WHEN length(clean) > 120 THEN left(clean, 120) || '...' ELSE clean END AS preview FROM e""",
    "line_sections": rf"""WITH {_DOCS}, {_LINES},
h AS (SELECT doc_id, line_no, regexp_replace(lower(line), ':.*$', '') AS h FROM lines WHERE line <> ''),
o AS (SELECT doc_id, line_no, CASE {' '.join(f"WHEN h IN ({', '.join(repr(x) for x in xs)}) THEN '{n}'" for n, xs in X.SECTIONS.items())} END AS own FROM h)
SELECT doc_id, line_no, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'head') AS section, own IS NOT NULL AS is_heading FROM o""",
    "file_names": r"""WITH f AS (SELECT request_id, min(resume_file) AS f FROM anonymize_request GROUP BY 1),
a AS (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(f, '^.*[/\\]', ''), '\.[A-Za-z0-9]{1,5}$', ''), '\s*(?:\(\d+\)|\[\d+\]|\{\d+\})', '', 'g') AS s FROM f),
b AS (SELECT request_id, string_split_regex(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-.+]+', ' ', 'g'), '\s+') AS w FROM a),
c AS (SELECT request_id, array_to_string(list_filter(w, lambda x: x <> '' AND NOT regexp_matches(x, '^\d+$') AND lower(x) NOT IN ('resume', 'cv', 'curriculum', 'vitae', 'final', 'updated', 'new', 'copy', 'request')), ' ') AS n FROM b)
SELECT request_id, nullif(array_to_string(list_transform(regexp_extract_all(n, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(left(x, 1)) || lower(substring(x, 2))), ''), '') AS candidate_name FROM c""",
    "skill_match": rf"""WITH {_DOCS}, {_LINES}, {_TOKENS},
m AS (SELECT g.doc_id, t.skill, t.category, g.line_no, g.pos FROM grams g JOIN tax t USING (surface))
SELECT doc_id, skill, min(category) AS category, arg_min(line_no, line_no * 100000 + pos) AS line_no, arg_min(pos, line_no * 100000 + pos) AS pos FROM m GROUP BY 1, 2""",
    "skill_match_guarded": rf"""WITH {_DOCS}, {_LINES}, {_NEAR_TOKENS}, {_TOKENS}, {_SHORT}
SELECT DISTINCT doc_id, skill FROM near JOIN (SELECT surface, skill FROM tax UNION ALL SELECT surface, skill FROM short) USING (surface) WHERE {_GUARDED}""",
    "skill_confidence": rf"""WITH {_DOCS}, {_LINES}, {_NEAR_TOKENS}, {_TOKENS},
m AS (SELECT DISTINCT n.doc_id, n.line_no, t.skill, n.raw FROM near n JOIN tax t USING (surface)),
st AS (SELECT m.doc_id, m.skill, m.raw, unnest(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM m JOIN lines USING (doc_id, line_no)),
w AS (SELECT doc_id, skill, {spaced_sql("sentence")} AS x, {spaced_sql("raw")} AS q FROM st),
p AS (SELECT *, instr(x, q) AS spot FROM w WHERE contains(x, q)), c AS (SELECT *, left(x, spot) AS bef, substring(x, spot + length(q) - 1) AS aft FROM p),
e AS (SELECT *, substring(bef, {_LAST_TURN} + 1) AS tail, left(aft, {_FIRST_TURN}) AS head FROM c)
SELECT doc_id, skill, min(CASE WHEN {holds_sql("tail", S.WEAKENING)} OR {_SOON} OR ({holds_sql("x", S.WEAKENING)} AND NOT {holds_sql("x", S.TURNING)}) THEN 'low' ELSE 'high' END) AS confidence FROM e GROUP BY 1, 2""",
    "skill_match_unguarded": rf"""WITH {_DOCS}, {_LINES}, {_TOKENS}, {_SHORT}
SELECT DISTINCT doc_id, skill FROM grams JOIN (SELECT surface, skill FROM tax UNION ALL SELECT surface, skill FROM short) USING (surface)""",
    "skill_category_rollup": rf"""WITH {_DOCS}, {_LINES}, {_TOKENS},
m AS (SELECT DISTINCT g.doc_id, t.skill, t.category FROM grams g JOIN tax t USING (surface))
SELECT category, skill, count(*) AS n_docs, CAST(grouping_id(category, skill) AS INTEGER) AS level FROM m GROUP BY ROLLUP (category, skill)""",
}

QUERIES = {f.__name__: f for f in (clean_text, line_sections, sentence_chunks, skill_match, skill_match_guarded, skill_match_unguarded, skill_category_rollup, skill_confidence, file_names)}
