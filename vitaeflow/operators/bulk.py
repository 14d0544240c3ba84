"""Many resumes at once: status of each file, fits of years and degrees, components of a match, and recall of redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.operators.joins import join_lookup
from vitaeflow.operators.matching import PRESETS
from vitaeflow.sources.scratch import cut_lineage


def file_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, status, first_key``: failed where there is no text, duplicate where a smaller key has the same text, else analyzed. ``first_key`` is its own key where it isn't a duplicate.

    A row fails by itself; no other row is touched. Only hashes are shuffled, combined per task before, so that a text with a third
    of all rows is one row a task. Repeated keys must be dropped before.
    """
    h = df.select(F.col(key), F.when(F.trim(text) != "", F.sha2(text, 256)).alias("h"))
    first = cut_lineage(h.where("h is not null").groupBy("h").agg(F.min(key).alias("first_key"), F.count("*").alias("n")))
    read = join_lookup(h.where("h is not null"), first, ["h"], "n").select(key, F.when(F.col(key) == F.col("first_key"), "analyzed").otherwise("duplicate").alias("status"), "first_key")
    return read.unionByName(h.where("h is null").select(key, F.lit("failed").alias("status"), F.col(key).alias("first_key")))


def status_counts(status: DataFrame) -> DataFrame:
    """``status, n`` with a row ``total``."""
    c = status.groupBy("status").agg(F.count("*").alias("n"))
    return c.unionByName(c.agg(F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def candidate_years(full_time_months: Column, professional_months: Column, internship_months: Column, phrase_years: Column) -> Column:
    """Years of a candidate: of full-time months, else of professional months where there are no internships, else as the text states them, else 0."""
    years = lambda m: F.round(m / 12, 2)
    counted = F.when(full_time_months > 0, years(full_time_months)).when((professional_months > 0) & (F.coalesce(internship_months, F.lit(0)) == 0), years(professional_months))
    return F.coalesce(counted, F.when(phrase_years > 0, phrase_years.cast("double")), F.lit(0.0))


def years_fit(candidate: Column, required: Column) -> Column:
    """Share of the required years, at most 1; 1 where none are required."""
    return F.when(required > 0, F.round(F.least(candidate / required, F.lit(1.0)), 4)).otherwise(F.lit(1.0))


def degree_fit(candidate: Column, required: Column) -> Column:
    """1 where the level is met or none is required, else a half."""
    return F.when((required > 0) & (candidate < required), F.lit(0.5)).otherwise(F.lit(1.0))


def rescaled(preset: str, without: str) -> dict[str, float]:
    """The weights of a preset without one component, scaled to sum to 1 again; all 0 where nothing stays."""
    rest = {k: w for k, w in PRESETS[preset].items() if k != without}
    total = sum(rest.values())
    return {k: (w / total if total else 0.0) for k, w in rest.items()} | {without: 0.0}


def with_weight(preset: str, component: str, weight: float) -> dict[str, float]:
    """The weights of a preset where one component has the given weight and the others share the rest in proportion."""
    return {k: w * (1 - weight) for k, w in rescaled(preset, component).items()} | {component: weight}


def weighted(weights: dict[str, float], columns: dict[str, str]) -> Column:
    """The weighted sum of components, within 0 and 1; a missing component counts 0."""
    total = sum((F.lit(w) * F.coalesce(F.col(columns[k]), F.lit(0.0)) for k, w in weights.items() if k in columns), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


# Spellings of types of personal data.
PII_TYPES = {"person": "name", "full name": "name", "tel": "phone", "telephone": "phone", "mobile": "phone", "e-mail": "email", "mail": "email", "addr": "address", "id": "id_number", "id number": "id_number", "national id": "id_number"}


def pii_type(written: Column) -> Column:
    """One spelling of a type; ``unknown`` where none is given."""
    t = F.lower(F.trim(written))
    same = F.create_map(*[F.lit(x) for kv in PII_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(same, t), F.nullif(t, F.lit("")), F.lit("unknown"))


def redaction_recall(labels: DataFrame, texts: DataFrame, file: str, kind: str, value: str, redacted: str) -> DataFrame:
    """``pii_type, labelled, gone, recall`` with rows ``micro`` and ``macro``: of the labelled values those that their redacted text no longer holds.

    Labels meet texts by file; a file with several texts counts a value as gone where none of them holds it.
    """
    j = labels.where(F.trim(value) != "").select(F.col(file).alias("f"), pii_type(F.col(kind)).alias("pii_type"), F.lower(F.trim(value)).alias("v")).join(texts.select(F.col(file).alias("f"), F.lower(redacted).alias("r")), "f")
    one = j.groupBy("f", "pii_type", "v").agg(F.max(F.contains("r", F.col("v"))).alias("there"))
    by = one.groupBy("pii_type").agg(F.count("*").alias("labelled"), F.count(F.when(~F.coalesce("there", F.lit(False)), 1)).alias("gone"))
    by = cut_lineage(by.withColumn("recall", F.round(F.col("gone") / F.col("labelled"), 4)))
    whole = by.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("gone"), F.lit(0)).alias("gone"), F.avg(F.col("gone") / F.col("labelled")).alias("mean"))
    micro = whole.select(F.lit("micro").alias("pii_type"), "labelled", "gone", F.round(F.when(F.col("labelled") > 0, F.col("gone") / F.col("labelled")).otherwise(0.0), 4).alias("recall"))
    macro = whole.select(F.lit("macro").alias("pii_type"), "labelled", "gone", F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("recall"))
    return by.unionByName(micro).unionByName(macro)
