"""One row per key for wide rows, without a shuffle by key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.sources.scratch import broadcaster, cut_lineage


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Any one row of each key; for tables whose repeated rows have the same content.

    Of rows read from files only keys and places are aggregated. The few keys that occur more than once, each with the place to keep, are
    joined back, by broadcast up to a checked number, so that wide rows stay where they are read and are read once. Rows
    without a place (computed ones) are aggregated whole by key. A null key counts as one key. Empty tables stay empty;
    other columns are carried along.
    """
    try:
        placed = df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        placed.schema  # noqa: B018 - resolves the names
    except AnalysisException:
        rest = [c for c in df.columns if c != key]
        firsts = F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__r") if rest else F.count("*").alias("__r")
        return df.groupBy(key).agg(firsts).select(F.col(key), *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*df.columns)
    seen = placed.select(F.col(key).alias("__key"), F.struct("__file", "__row").alias("at")).groupBy("__key").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    again = cut_lineage(seen.where("n > 1").select("__key", F.col("at.__file").alias("__kf"), F.col("at.__row").alias("__kr")))
    kept = placed.join(broadcaster(again)(again), placed[key].eqNullSafe(again["__key"]), "left")
    kept = kept.where("__kr is null or (__kf = __file and __kr = __row)").select(*df.columns)
    # A table of few files would be worked on by few tasks; only then its rows are spread over the cores.
    cores = df.sparkSession.sparkContext.defaultParallelism
    return kept if df._jdf.rdd().getNumPartitions() >= cores else kept.repartition(cores)
