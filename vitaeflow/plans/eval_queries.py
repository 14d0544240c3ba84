"""Queries that evaluate labels and ratings, and rewrite bullets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vitaeflow.functions.phrases import spaced_sql
from vitaeflow.operators import metrics as M
from vitaeflow.operators import rewrite as R
from vitaeflow.operators import text as X
from vitaeflow.plans.profile_queries import _doc_lines
from vitaeflow.plans.text_queries import _DOCS, _LINES, _mentions
from vitaeflow.sources.scratch import broadcaster
from vitaeflow.sources.tables import latest_by_key, read_table

RATERS = ["rater1", "rater2", "rater3", "rater4"]


def _results(spark, d):
    cols = ["resume_id", "tp_count", "fp_count", "fn_count", "extracted_skills", "true_positives", "false_negatives", "evaluated_at"]
    return latest_by_key(read_table(spark, d, "skill_eval_results").select(*cols), "resume_id", "evaluated_at")


def prf_micro_macro(spark, d):
    return M.prf_micro_macro(_results(spark, d).select(F.col("tp_count").alias("tp"), F.col("fp_count").alias("fp"), F.col("fn_count").alias("fn")))


def _items(df, column):
    return df.select("resume_id", F.explode(F.filter(F.transform(F.split(column, ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("skill"))


def label_counts(spark, d):
    r = _results(spark, d)
    return M.labels_against_found(_items(r, "true_positives").unionByName(_items(r, "false_negatives")), _items(r, "extracted_skills"), "resume_id", "skill")


def top_errors(spark, d):
    return M.top_errors(_items(_results(spark, d), "false_negatives"), "skill", "resume_id")


def non_canonical_labels(spark, d):
    refs = read_table(spark, d, "reference_values").where("kind = 'skill'").select(F.lower("canonical").alias("skill"))
    i = _items(_results(spark, d), "false_negatives").withColumn("skill", F.lower("skill"))
    return i.join(broadcaster(refs)(refs), "skill", "left_anti").groupBy("skill").agg(F.count("*").alias("n"))


def _ratings(spark, d):
    p = latest_by_key(read_table(spark, d, "pairs_template").select("pair_id", "panel_id", "jd_file", *RATERS, "exported_at"), "pair_id", "exported_at")
    return p.select("pair_id", "panel_id", "jd_file", *[F.when(F.col(r).between(0, 100), F.col(r)).alias(r) for r in RATERS])


def human_means(spark, d):
    vals = F.filter(F.array(*RATERS), lambda x: x.isNotNull())
    m = _ratings(spark, d).select("pair_id", F.size(vals).alias("n"), F.round(F.aggregate(vals, F.lit(0.0), lambda s, x: s + x) / F.size(vals), 4).alias("mean"))
    return m.where("n > 0").withColumn("n", F.col("n").cast("bigint"))


def rater_agreement(spark, d):
    return M.rater_pairs(_ratings(spark, d), "pair_id", RATERS, ["panel_id"])


def pearson_spearman(spark, d):
    return M.correlation(_ratings(spark, d), "rater1", "rater2", ["panel_id"])


def percentile_anchors(spark, d):
    return M.anchors(_ratings(spark, d).withColumn("v", F.col("rater1") / 100), "v", "rater2")


def kfold_assign(spark, d):
    return _ratings(spark, d).select("pair_id", M.fold_of(F.col("jd_file")).alias("fold"))


def grid_search(spark, d):
    """Settings that mix two raters' values to meet a third's."""
    f = _ratings(spark, d).where("rater1 is not null and rater2 is not null and rater3 is not null").select("pair_id", (F.col("rater1") / 100).alias("a"), (F.col("rater2") / 100).alias("b"), F.col("rater3").alias("h"))
    return M.grid_search(f, "pair_id", "a", "b", "h", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.1, 0.2, 0.3], [0.55, 0.65, 0.75])


def confusion_matrix(spark, d):
    """Bands of two raters against each other."""
    band = lambda c: F.when(F.col(c) >= 70, "strong").when(F.col(c) >= 40, "moderate").otherwise("weak")
    return M.confusion(_ratings(spark, d).where("rater1 is not null and rater3 is not null").select(band("rater1").alias("x"), band("rater3").alias("y")), "x", "y")


def classification_report(spark, d):
    band = lambda c: F.when(F.col(c) >= 70, "strong").when(F.col(c) >= 40, "moderate").otherwise("weak")
    return M.classification_report(_ratings(spark, d).where("rater1 is not null and rater3 is not null").select(band("rater1").alias("x"), band("rater3").alias("y")), "x", "y")


def paired_difference(spark, d):
    return M.paired_difference(_ratings(spark, d), "rater1", "rater3")


def kind_shares(spark, d):
    return M.value_counts(read_table(spark, d, "documents").groupBy("doc_id").agg(F.min("doc_kind").alias("doc_kind")), "doc_kind")


def _bullets(spark, d):
    lines = X.with_sections(_doc_lines(spark, d), "doc_id")
    resumes = read_table(spark, d, "documents").where("doc_kind = 'resume'").select("doc_id").distinct()
    b = R.bullets_of(lines.join(resumes, "doc_id", "left_semi"), "doc_id")
    named = _mentions(spark, d, False).select("doc_id", "line_no").distinct().withColumn("has_skill", F.lit(True))
    return b.join(named, ["doc_id", "line_no"], "left").withColumn("reasons", R.weak_reasons(F.col("bullet"), F.coalesce("has_skill", F.lit(False))))


def weak_bullets(spark, d):
    return R.suggestions(_bullets(spark, d), "doc_id").select("doc_id", "rank", F.array_join("reasons", ";").alias("reasons"), R.rewritten(F.col("bullet")).alias("rewritten"))


def bullet_openers(spark, d):
    o = R.opener_of(F.regexp_replace("line", r"^\s*(?:[-*•▪●–]|\d{1,2}[.)])\s*", ""))
    return _doc_lines(spark, d).select(o.alias("opener")).where("opener is not null").groupBy("opener").agg(F.count("*").alias("n"))


def bullet_categories(spark, d):
    c = _doc_lines(spark, d).select(R.category_of(F.col("line")).alias("category")).where("category is not null")
    return c.groupBy("category").agg(F.count("*").alias("n"))


_RES = "r AS (SELECT resume_id, any_value(tp_count) AS tp, any_value(fp_count) AS fp, any_value(fn_count) AS fn, any_value(true_positives) AS tps, any_value(false_negatives) AS fns, any_value(extracted_skills) AS ext FROM skill_eval_results GROUP BY 1)"
_RAT = "r AS (SELECT pair_id, any_value(panel_id) AS panel_id, any_value(jd_file) AS jd_file, " + ", ".join(f"CASE WHEN any_value({x}) BETWEEN 0 AND 100 THEN any_value({x}) END AS {x}" for x in RATERS) + " FROM pairs_template GROUP BY 1)"
_BANDS = "b AS (SELECT CASE WHEN rater1 >= 70 THEN 'strong' WHEN rater1 >= 40 THEN 'moderate' ELSE 'weak' END AS actual, CASE WHEN rater3 >= 70 THEN 'strong' WHEN rater3 >= 40 THEN 'moderate' ELSE 'weak' END AS predicted FROM r WHERE rater1 IS NOT NULL AND rater3 IS NOT NULL)"
_SAFE = "CASE WHEN count(*) > 1 AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN corr(x, y) ELSE 0 END"

_OPENERS = " ".join(rf"WHEN regexp_matches(l, '(?i)^(i\s+|my\s+|(i\s+)?was\s+)?{p}\b') THEN '{p}'" for p in R.OPENERS)

SQL = {
    "prf_micro_macro": f"""WITH {_RES}, o AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q, * FROM r), a AS (SELECT sum(tp) / nullif(sum(tp + fp), 0) AS mp, sum(tp) / nullif(sum(tp + fn), 0) AS mq, avg(p) AS p, avg(q) AS q, avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END) AS f FROM o)
SELECT 'micro' AS average, round(mp, 4) AS precision, round(mq, 4) AS recall, round(2 * mp * mq / (mp + mq), 4) AS f1 FROM a UNION ALL SELECT 'macro', round(p, 4), round(q, 4), round(f, 4) FROM a""",
    "label_counts": f"""WITH {_RES}, l AS (SELECT resume_id, trim(unnest(string_split(tps, ';'))) AS s FROM r UNION SELECT resume_id, trim(unnest(string_split(fns, ';'))) FROM r), e AS (SELECT DISTINCT resume_id, trim(unnest(string_split(ext, ';'))) AS s FROM r)
SELECT coalesce(l.resume_id, e.resume_id) AS resume_id, count(*) FILTER (l.s IS NOT NULL AND e.s IS NOT NULL) AS tp, count(*) FILTER (l.s IS NULL) AS fp, count(*) FILTER (e.s IS NULL) AS fn FROM (SELECT * FROM l WHERE s <> '') l FULL JOIN (SELECT * FROM e WHERE s <> '') e ON l.resume_id = e.resume_id AND l.s = e.s GROUP BY 1""",
    "top_errors": f"""WITH {_RES}, e AS (SELECT resume_id, trim(unnest(string_split(fns, ';'))) AS skill FROM r) SELECT skill, count(*) AS n, count(DISTINCT resume_id) AS n_keys FROM e WHERE skill <> '' GROUP BY 1 ORDER BY n DESC, skill COLLATE "C" LIMIT 15""",
    "non_canonical_labels": f"""WITH {_RES}, e AS (SELECT lower(trim(unnest(string_split(fns, ';')))) AS skill FROM r) SELECT skill, count(*) AS n FROM e WHERE skill <> '' AND skill NOT IN (SELECT lower(canonical) FROM reference_values WHERE kind = 'skill') GROUP BY 1""",
    "human_means": f"""WITH {_RAT}, v AS (SELECT pair_id, unnest([rater1, rater2, rater3, rater4]) AS x FROM r) SELECT pair_id, count(x) AS n, round(avg(x), 4) AS mean FROM v GROUP BY 1 HAVING count(x) > 0""",
    "rater_agreement": f"""WITH {_RAT}, v AS (""" + " UNION ALL ".join(f"SELECT panel_id, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM r" for i, a in enumerate(RATERS) for b in RATERS[i + 1 :]) + f""") SELECT panel_id, a, b, count(*) AS n, round(avg(abs(x - y)), 4) AS mad, round({_SAFE}, 4) AS pearson FROM v WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""",
    "pearson_spearman": f"""WITH {_RAT}, v AS (SELECT panel_id, rater1 AS a, rater2 AS b FROM r WHERE rater1 IS NOT NULL AND rater2 IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY panel_id ORDER BY a) + (count(*) OVER (PARTITION BY panel_id, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY panel_id ORDER BY b) + (count(*) OVER (PARTITION BY panel_id, b) - 1) / 2.0 AS y FROM v)
SELECT panel_id, count(*) AS n, round(avg(abs(a - b)), 4) AS mae, round({_SAFE.replace('(x', '(a').replace('y)', 'b)')}, 4) AS pearson, round({_SAFE}, 4) AS spearman FROM k GROUP BY 1""",
    "percentile_anchors": f"""WITH {_RAT} SELECT round(quantile_cont(rater1 / 100, 0.05) FILTER (rater2 < 30), 4) AS low, round(quantile_cont(rater1 / 100, 0.95) FILTER (rater2 > 70), 4) AS high FROM r""",
    "kfold_assign": f"""WITH {_RAT} SELECT pair_id, CAST(('0x' || left(md5(jd_file), 8))::BIGINT % 5 AS BIGINT) AS fold FROM r""",
    "grid_search": f"""WITH {_RAT}, g AS (SELECT * FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::DOUBLE AS w), (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS low), (SELECT unnest([0.55, 0.65, 0.75])::DOUBLE AS high)),
f AS (SELECT ('0x' || left(md5(pair_id), 8))::BIGINT % 5 AS fold, rater1 / 100 AS a, rater2 / 100 AS b, rater3 AS h FROM r WHERE rater1 IS NOT NULL AND rater2 IS NOT NULL AND rater3 IS NOT NULL),
e AS (SELECT w, low, high, fold, avg(abs(100 * ((1 - w) * a + w * least(greatest((b - low) / (high - low), 0), 1)) - h)) AS m FROM f, g GROUP BY ALL) SELECT w, low, high, round(avg(m), 4) AS cv_mae FROM e GROUP BY ALL""",
    "confusion_matrix": f"""WITH {_RAT}, {_BANDS} SELECT actual, predicted, count(*) AS n FROM b GROUP BY ALL""",
    "classification_report": f"""WITH {_RAT}, {_BANDS}, l AS (SELECT actual AS label FROM b UNION SELECT predicted FROM b), s AS (SELECT label, (SELECT count(*) FROM b WHERE actual = label AND predicted = label) AS tp, (SELECT count(*) FROM b WHERE actual = label) AS support, (SELECT count(*) FROM b WHERE predicted = label) AS found FROM l), p AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM s)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM p""",
    "kind_shares": """WITH k AS (SELECT doc_id, any_value(doc_kind) AS v FROM documents GROUP BY 1) SELECT coalesce(v, '(null)') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1""",
    "bullet_openers": rf"""WITH {_DOCS}, {_LINES}, b AS (SELECT regexp_replace(line, '^\s*([-*•▪●–]|\d{{1,2}}[.)])\s*', '') AS l FROM lines), o AS (SELECT CASE {_OPENERS} END AS opener FROM b) SELECT opener, count(*) AS n FROM o WHERE opener IS NOT NULL GROUP BY 1""",
    "bullet_categories": rf"""WITH {_DOCS}, {_LINES}, w AS (SELECT row_number() OVER () AS id, {spaced_sql("line")} AS w FROM lines WHERE line <> ''),
c AS ({' UNION ALL '.join(f"SELECT id, '{n}' AS category, {i} AS o, " + " + ".join(f"contains(w, ' {' '.join(re.split('[-/]', x))} ')::INT" for x in words) + " AS n FROM w" for i, (n, words) in enumerate(R.TRIGGERS.items()))}),
t AS (SELECT id, arg_max(category, n * 100 - o) AS category FROM c WHERE n > 0 GROUP BY 1) SELECT category, count(*) AS n FROM t GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (prf_micro_macro, label_counts, top_errors, non_canonical_labels, human_means, rater_agreement, pearson_spearman, percentile_anchors, kfold_assign, grid_search, confusion_matrix, classification_report, paired_difference, kind_shares, weak_bullets, bullet_openers, bullet_categories)}
