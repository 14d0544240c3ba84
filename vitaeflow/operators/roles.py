"""Role of a text: TF-IDF with a linear model in Spark ML, folds by hash, top roles, uncertainty."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.operators.metrics import fold_of
from vitaeflow.operators.similarity import terms
from vitaeflow.sources.scratch import cut_lineage, is_small

#: Rows a model is fitted on, drawn by a hash of the key, where someone sets a bound; none is set, a model is fitted on all rows.
SAMPLE: int | None = None
#: A text whose best role is less probable is uncertain.
UNCERTAIN = 0.35


def prepared(df: DataFrame, text: str, label: str | None = None) -> DataFrame:
    """With ``terms``: the distinct words and pairs of neighbours; none for a null text."""
    out = df.withColumn("terms", F.coalesce(F.array_distinct(terms(F.col(text))), F.array().cast("array<string>")))
    return out if label is None else out.withColumn("label_text", F.col(label))


def train_roles(df: DataFrame, key: str, text: str, label: str, features: int = 1 << 14, c: float = 10.0) -> PipelineModel:
    """Hashed TF-IDF, unit length, logistic regression with weights that balance the classes."""
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    if SAMPLE is not None and not is_small(known, SAMPLE):  # keys alone are sorted; at most SAMPLE of them are broadcast
        known = known.join(F.broadcast(cut_lineage(known.select(key).orderBy(F.xxhash64(key)).limit(SAMPLE))), key, "left_semi")
    data = prepared(known, text, label)
    sizes = cut_lineage(data.groupBy("label_text").agg(F.count("*").alias("size")))  # a row per class
    total = sizes.agg(F.sum("size").alias("all"), F.count("*").alias("classes"))
    data = data.join(F.broadcast(sizes), "label_text").crossJoin(F.broadcast(total)).withColumn("weight", F.col("all") / (F.col("classes") * F.col("size")))  # a row per class, one row
    # The terms of all rows are several times the input: idf, moments and blocks of vectors each make them anew out of the texts; the iterations pass over the blocks.
    data = data.select("terms", "label_text", "weight")
    stages = [
        StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc"), HashingTF(inputCol="terms", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf", minDocFreq=2),
        Normalizer(inputCol="idf", outputCol="features"), LogisticRegression(maxIter=30, regParam=1 / (c * 1000), weightCol="weight"),
    ]
    return Pipeline(stages=stages).fit(data)


def top_roles(model: PipelineModel, df: DataFrame, key: str, text: str, k: int = 4) -> DataFrame:
    """``key, rank, role, probability`` (percent, two places): the k most probable roles, ties by name. Sorted within each row, each key once; nothing is shuffled."""
    if k < 1:
        raise ValueError("k must be at least 1.")
    labels = model.stages[0].labels
    rest = PipelineModel(model.stages[1:])
    names = F.array(*map(F.lit, labels))
    each = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("minus"), F.element_at(names, i + 1).alias("role")))
    best = rest.transform(prepared(df, text)).select(F.col(key), F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("i", "r"))
    return best.select(key, (F.col("i") + 1).alias("rank"), "r.role", F.round(-F.col("r.minus") * 100, 2).alias("probability"))


def held_out(df: DataFrame, key: str, text: str, label: str, fold: int = 0) -> DataFrame:
    """``key, actual, predicted, probability`` of one fold by a model of the others."""
    f = df.withColumn("__fold", fold_of(F.col(key)))
    model = train_roles(f.where(F.col("__fold") != fold).drop("__fold"), key, text, label)
    rest = f.where(F.col("__fold") == fold)
    best = top_roles(model, rest, key, text, 1)
    return rest.select(key, F.col(label).alias("actual")).join(best, key).select(key, "actual", F.col("role").alias("predicted"), (F.col("probability") / 100).alias("probability"))


def without_title_words(text: Column, titles: list[str]) -> Column:
    """The text without the words of role titles, for a test of leakage."""
    words = sorted({w for t in titles for w in t.lower().split() if len(w) > 2}, key=lambda w: (-len(w), w))
    if not words:
        return text
    return F.regexp_replace(text, r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", " ")


def save_model(model: PipelineModel, path: str) -> None:
    """Write a model to a folder that all executors share, in place of an earlier one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

