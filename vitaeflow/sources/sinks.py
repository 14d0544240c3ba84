"""Results as files: CSV, JSON without personal columns, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that name a person.
PERSONAL = ("name", "candidate_name", "email", "phone", "links", "linkedin", "github", "address", "filename", "resume_file", "extracted_text", "raw_text")


def write_csv(df: DataFrame, folder: str, one_file: bool = False) -> None:
    """CSV with a header; lists joined. ``one_file`` is for reports that fit a task."""
    flat = df.select(*[F.array_join(F.col(n).cast("array<string>"), "; ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def without_personal(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in PERSONAL])


def dossiers(df: DataFrame, key: str) -> DataFrame:
    """``key, json``: each row without personal columns as JSON."""
    kept = without_personal(df)
    return kept.select(F.col(key), F.to_json(F.struct(*kept.columns)).alias("json"))
