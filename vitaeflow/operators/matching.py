"""Candidates against requirements: set algebra, coverage, weighted scores under presets, and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.functions.phrases import bound, first_that, holds, spaced_text

# Weights of the components in each preset.
PRESETS = {
    "skills_only": {"skill": 1.0, "semantic": 0.0, "experience": 0.0, "education": 0.0, "recency": 0.0},
    "hybrid": {"skill": 0.70, "semantic": 0.30, "experience": 0.0, "education": 0.0, "recency": 0.0},
    "proposal": {"skill": 0.40, "semantic": 0.40, "experience": 0.10, "education": 0.10, "recency": 0.0},
    "composite": {"skill": 0.40, "semantic": 0.30, "experience": 0.15, "education": 0.0, "recency": 0.15},
}
REQUIRED_SHARE, PREFERRED_SHARE = 0.80, 0.20


def presets_table(spark: SparkSession) -> DataFrame:
    names = ("skill", "semantic", "experience", "education", "recency")
    return spark.createDataFrame([(m, *[p[n] for n in names]) for m, p in PRESETS.items()], "mode string, " + ", ".join(f"w_{n} double" for n in names))


def coverage(held: Column, required: Column, preferred: Column) -> Column:
    """Share of required and preferred names that are held, 0.8 to 0.2; one alone where the other is empty; 0 where both are."""
    part = lambda want: F.size(F.array_intersect(held, want)) / F.greatest(F.size(want), F.lit(1))
    nr, np_ = F.size(required), F.size(preferred)
    return F.round(F.when((nr > 0) & (np_ > 0), REQUIRED_SHARE * part(required) + PREFERRED_SHARE * part(preferred)).when(nr > 0, part(required)).when(np_ > 0, part(preferred)).otherwise(0.0), 4)


def adjusted_coverage(wanted: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, coverage``: like ``coverage``, where a held name counts its multiplier (1 where there is none).

    ``wanted`` has ``*keys, skill, required`` (boolean); ``evidence`` has the first key, skill and multiplier of what is held. They meet on
    (key, skill); the sums are combined before the shuffle by keys.
    """
    j = wanted.join(evidence.select(keys[0], "skill", F.coalesce("multiplier", F.lit(1.0)).alias("m")), [keys[0], "skill"], "left")
    part = lambda want: F.sum(F.when(F.col("required") == want, F.coalesce("m", F.lit(0.0)))) / F.greatest(F.count(F.when(F.col("required") == want, 1)), F.lit(1))
    n = lambda want: F.count(F.when(F.col("required") == want, 1))
    both = F.when((n(True) > 0) & (n(False) > 0), REQUIRED_SHARE * part(True) + PREFERRED_SHARE * part(False)).when(n(True) > 0, part(True)).when(n(False) > 0, part(False)).otherwise(0.0)
    return j.groupBy(*keys).agg(F.round(both, 4).alias("coverage"))


def group_score(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``*keys, score``: the mean weight of required and of preferred names, 0.8 to 0.2; one alone where the other is missing."""
    r, p = F.avg(F.when(F.col("required"), F.col(weight))), F.avg(F.when(~F.col("required"), F.col(weight)))
    return df.groupBy(*keys).agg(F.round(F.coalesce(REQUIRED_SHARE * r + PREFERRED_SHARE * p, r, p, F.lit(0.0)), 4).alias("score"))


def gaps(held: Column, wanted: Column) -> Column:
    """``struct<matched, missing>``, sorted."""
    return F.struct(F.array_sort(F.array_intersect(wanted, held)).alias("matched"), F.array_sort(F.array_except(wanted, held)).alias("missing"))


def recommendations(missing_required: Column, missing_preferred: Column, n: int = 10) -> Column:
    """Missing required names first, then preferred ones, each in order; the first n."""
    return F.slice(F.array_distinct(F.concat(F.array_sort(missing_required), F.array_sort(missing_preferred))), 1, n)


def score_all_modes(components: DataFrame, key: str, presets: DataFrame) -> DataFrame:
    """``key, mode, score``: weighted components, each rounded before the sum. Without a semantic value a row is scored by
    skills alone. The presets are a table of four rows and broadcast as such."""
    names = ("skill", "semantic", "experience", "education", "recency")
    j = components.crossJoin(F.broadcast(presets))
    parts = [F.round(F.col(f"w_{n}") * F.coalesce(F.col(n), F.lit(0.0)), 4) for n in names]
    total = F.when(F.col("semantic").isNull(), F.col("skill")).otherwise(reduce(lambda a, b: a + b, parts))
    return j.select(key, "mode", F.least(F.greatest(F.round(total, 4), F.lit(0.0)), F.lit(1.0)).alias("score"))


def rank_candidates(df: DataFrame, per: list[str], key: str, top_n: int | None = None) -> DataFrame:
    """``df`` with ``rank``, by match_score, skills_match_count, months (professional, else years * 12), freelance months, name, key.

    ``top_n`` below 1 is an error; beyond the number of rows all come out. Within one group Spark first keeps the top n of
    each task where ``top_n`` is given (the filter on row_number), so that a group needn't fit one task.
    """
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be at least 1.")
    order = [
        F.desc(F.coalesce("match_score", F.lit(0.0))), F.desc(F.coalesce("skills_match_count", F.lit(0))), F.desc(F.coalesce("professional_months", F.col("experience_years") * 12, F.lit(0))),
        F.desc(F.coalesce("freelance_months", F.lit(0))), F.lower(F.coalesce(F.nullif("candidate_name", F.lit("")), "filename", F.lit(""))), F.col(key),
    ]
    ranked = df.where("status = 'analyzed'").withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def export_rows(ranked: DataFrame) -> DataFrame:
    """Ranked rows as text columns for a CSV sink: scores as whole percents (half to even), lists joined, defaults written out."""
    return ranked.select(
        "rank", F.coalesce("candidate_name", F.lit("N/A")).alias("candidate_name"), F.bround(F.col("match_score") * 100, 0).cast("int").alias("match_percent"),
        F.coalesce(F.nullif(F.array_join("matched", ", "), F.lit("")), F.lit("None")).alias("matched_skills"), F.coalesce(F.nullif(F.array_join("missing", ", "), F.lit("")), F.lit("None")).alias("missing_skills"),
        F.coalesce(F.col("experience_years").cast("string"), F.lit("Not indicated")).alias("experience"),
    )


# Headings that open the required, the preferred or another part of a job text, and words within lines that say so.
REQUIRED_HEADINGS = (
    "requirement", "requirements", "required", "required skill", "required skills", "required qualification", "required qualifications", "required experience", "mandatory", "mandatory skill", "mandatory skills",
    "mandatory qualification", "mandatory qualifications", "mandatory experience", "must have", "must haves", "must have skill", "must have skills", "must haves skills", "you must", "you will", "you should", "minimum qualification", "minimum qualifications",
    "essential", "essential skill", "essential skills", "core skill", "core skills", "key skill", "key skills", "technical skill", "technical skills", "what you need", "what you'll need", "what we looking for", "what we're looking for",
)
PREFERRED_HEADINGS = (
    "preferred", "preferred skill", "preferred skills", "preferred qualification", "preferred qualifications", "preferred competencies", "nice to have", "nice to haves", "nice to have skill", "nice to have skills", "bonus", "bonus point", "bonus points",
    "bonus skill", "bonus skills", "plus", "pluses", "good to have", "good to have skill", "good to have skills", "desirable", "desirable skill", "desirable skills", "advantageous", "optional", "optional skill", "optional skills", "additional skill", "additional skills",
)
OTHER_HEADINGS = (
    "about", "about the role", "about the job", "about the company", "about the position", "about us", "about role", "about job", "about company", "about position", "about the", "about the us", "responsibilities", "duties", "role overview", "job description",
    "overview", "education", "preferred education", "qualifications", "experience", "work experience", "benefit", "benefits", "compensation", "salary", "how to apply", "application process", "what you do", "what you'll do", "what you bring", "what you'll bring",
    "what we", "what we offer", "what we expect", "who you are", "about you",
)
REQUIRED_WORDS = ("required", "must have", "must know", "mandatory", "essential", "you must", "minimum", "at least", "expect", "expected")
PREFERRED_WORDS = ("prefer", "preferre", "preferred", "nice to have", "bonus", "plus", "desirable", "advantage", "advantageous", "ideally", "optional", "good to have", "familiarity with")
# Words that begin a clause of their own before a colon or hyphen.
CLAUSE_HEADS = ("requirement", "requirements", "required", "must have", "must-have", "preferred", "nice to have", "nice-to-have", "bonus")


def heading_text(line: Column) -> Column:
    """A line as a heading: its words, without what stands in brackets at its end."""
    return F.trim(spaced_text(F.regexp_replace(line, r"[(][^()]*[)]\s*:?\s*$", "")))


def heading_part(line: Column) -> Column:
    """The part that a heading line opens, else null. A line with a sign between its words that isn't a hyphen is no heading."""
    alone = ~F.regexp_replace(line, r"[(][^()]*[)]\s*:?\s*$|^[\s#*_`•-]+|[\s*_`:-]+$", "").rlike("[^\\p{L}\\p{N}'’ -]")
    part = lambda words: first_that([(words.isin(*REQUIRED_HEADINGS), F.lit("required")), (words.isin(*PREFERRED_HEADINGS), F.lit("preferred")), (words.isin(*OTHER_HEADINGS), F.lit("other"))])
    return F.when(alone, bound(heading_text(line), part))


def clauses_of(line: Column) -> Column:
    """The sentences of a line, cut before a word of ``CLAUSE_HEADS`` with a colon or hyphen too."""
    marked = F.regexp_replace(line, r"(?<=[.!?])\s+", "\n")
    for head in CLAUSE_HEADS:
        marked = F.regexp_replace(marked, rf"(?i)(?<=\s)({head}\s*[:-])", "\n$1")
    return F.filter(F.transform(F.split(marked, "\n"), F.trim), lambda x: x != "")


def clause_part(clause: Column) -> Column:
    """By its own words: with neither kind it is required, with both preferred."""
    return F.when(bound(spaced_text(clause), lambda text: holds(text, PREFERRED_WORDS)), "preferred").otherwise("required")


def job_lines(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, clause, line, part``: 'required', 'preferred' or 'other' by the last heading, where a line is one clause; in a text without
    headings by the words of each clause."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = lines.withColumn("own", heading_part(F.col("line"))).withColumn("last", F.last("own", ignorenulls=True).over(w)).withColumn("headed", F.max(F.col("own").isin("required", "preferred")).over(Window.partitionBy(key)))
    headed = F.coalesce("headed", F.lit(False))
    cut = t.where("own is null").select(key, "line_no", "last", headed.alias("headed"), F.posexplode(F.when(headed, F.array("line")).otherwise(clauses_of(F.col("line")))).alias("clause", "line"))
    return cut.select(key, "line_no", (F.col("clause") + 1).alias("clause"), "line", F.when(F.col("headed"), F.coalesce("last", F.lit("other"))).otherwise(clause_part(F.col("line"))).alias("part"))


# Job families by words of a title, the first that fits.
FAMILIES = {
    "machine_learning": ("machine learning", "ml engineer", "ai engineer", "data scientist", "nlp engineer"),
    "data_engineering": ("data engineer", "data analyst", "analytics engineer", "bi developer"),
    "backend": ("backend", "back end", "api developer", "server side"),
    "frontend": ("frontend", "front end", "ui developer", "react developer", "vue developer"),
    "fullstack": ("fullstack", "full stack"),
    "devops": ("devops", "site reliability", "sre", "platform engineer", "cloud engineer", "infrastructure"),
    "mobile": ("mobile", "android", "ios", "flutter", "react native"),
    "software_engineering": ("software engineer", "software developer", "sde", "swe"),
    "product_management": ("product manager", "pm", "program manager"),
    "qa_testing": ("qa", "quality assurance", "test engineer", "sdet", "automation engineer"),
}


def job_family(title_zone: Column) -> Column:
    return bound(spaced_text(title_zone), lambda text: first_that([(holds(text, words), F.lit(name)) for name, words in FAMILIES.items()]))
