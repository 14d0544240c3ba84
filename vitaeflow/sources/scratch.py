"""The shared folder for checkpoints, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a narrow table is broadcast.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.

    Where none is set, a local session (all executors on this machine) gets one of its own; on a cluster that is an
    error, since executors couldn't read what others wrote.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vitaeflow-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages read files all executors share and survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """In as many partitions as the cluster has use for; for little data that takes much computing, which would
    otherwise sit in the few partitions its size asks for."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcaster(df: DataFrame, rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` where ``df`` has at most so many rows, else nothing, so that a shuffle join takes its place."""
    from pyspark.sql import functions as F

    return F.broadcast if is_small(df, rows) else (lambda d: d)
