"""Parquet tables of a data folder, and the rule that a key counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_by_key(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row per key: the newest stamp, ties settled by the whole row, so that the result doesn't
    depend on the order of the input. Rows whose key is null are left out; an empty table stays empty.

    For narrow rows: the aggregate carries whole rows. The rows of one key are combined before the
    shuffle, so a hot key costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in (key, stamp)]
    packed = F.max(F.struct(F.col(stamp).alias("__stamp"), *[F.col(f"`{c}`") for c in rest])).alias("__row")
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(packed)
        .select(F.col(key), *[F.col(f"__row.`{c}`").alias(c) for c in rest], F.col("__row.__stamp").alias(stamp))
        .select(*df.columns)
    )


def first_by_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key by ``order`` (a window; for rows with types that can't be compared)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
