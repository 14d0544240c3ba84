"""The expressions as SQL functions and a table function of a session."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.operators.profile import EMAIL, URL
from vitaeflow.operators.text import nfkc

# Stack of SQL bodies, kept in the engine: no Python runs for these.
_SQL = {
    "recency_weight(year INT, today INT)": "DOUBLE RETURN CASE WHEN year IS NULL THEN 0.5D ELSE round(least(1.0D, greatest(0.05D, power(0.5D, greatest(today - year, 0) / 3.0D))), 4) END",
    "normalize_similarity(cosine DOUBLE, low DOUBLE, high DOUBLE)": "DOUBLE RETURN CASE WHEN high <= low THEN 0D ELSE least(greatest((cosine - low) / (high - low), 0D), 1D) END",
    "candidate_ref(body STRING)": "STRING RETURN concat('C-', left(sha2(body, 256), 8))",
}


class ExtractEntities:
    """``kind, value`` of the e-mail addresses and links in a text."""

    def eval(self, text: str):
        for kind, pattern, group in (("email", EMAIL, 0), ("link", URL, 2)):
            for m in re.finditer(pattern, text or ""):
                yield kind, m.group(group)


def register(spark: SparkSession) -> None:
    """``nfkc``, ``word_count`` (Arrow batches), the SQL functions above and the table function ``extract_entities``."""

    @F.pandas_udf(T.IntegerType())
    def word_count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else len(t.split())).astype("Int32")

    spark.udf.register("nfkc", nfkc)
    spark.udf.register("word_count", word_count)
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {body}")
    spark.udtf.register("extract_entities", F.udtf(ExtractEntities, returnType="kind string, value string"))
