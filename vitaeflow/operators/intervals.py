"""Overlapping intervals: continuous periods per entity, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, step: int = 1) -> DataFrame:
    """``entity, kind ('period'|'gap'), start, end`` from closed integer intervals.

    Sorted by start per entity, an interval opens a new period where its start is beyond the running
    maximum of the previous ends plus ``step``; a cumulative sum labels the periods. Gaps lie between two
    neighbouring periods of one entity. Intervals with a null entity or end, or with end < start, are left
    out; repeated intervals change nothing; an empty table gives an empty result; other columns are ignored.

    Equal starts are first reduced to their largest end, combined before the shuffle. That changes no
    period, and an entity then has at most one row for each possible start, however hot its key is.
    """
    k, s, e = F.col(entity), F.col(start), F.col(end)
    thin = (
        df.where(k.isNotNull() & s.isNotNull() & e.isNotNull() & (e >= s))
        .groupBy(k.alias("__k"), s.alias("__s")).agg(F.max(e).alias("__e"))
    )
    by_start = Window.partitionBy("__k").orderBy("__s")
    seen = F.max("__e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    labelled = thin.withColumn("__seen", seen).withColumn(
        "__island", F.sum(F.when(F.col("__seen").isNull() | (F.col("__s") > F.col("__seen") + step), 1).otherwise(0)).over(by_start)
    )
    periods = labelled.groupBy("__k", "__island").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    before = F.lag("__e").over(Window.partitionBy("__k").orderBy("__island"))
    rows = periods.withColumn("__before", before).select(
        "__k",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("period").alias("kind"), F.col("__s").alias("s"), F.col("__e").alias("e")),
            F.when(F.col("__before").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("__before") + step).alias("s"), (F.col("__s") - step).alias("e"))),
        ))).alias("r"),
    )
    return rows.select(F.col("__k").alias(entity), F.col("r.kind").alias("kind"), F.col("r.s").alias(start), F.col("r.e").alias(end))
