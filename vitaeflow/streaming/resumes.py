"""Streams of resumes and events; the results equal those of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.operators.text import light_clean


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(df: DataFrame, text: str) -> DataFrame:
    """Stateless: the same expressions as in a batch."""
    return df.withColumn(text, light_clean(F.col(text)))


def first_copies(df: DataFrame, text: str, stamp: str, late: str = "30 days") -> DataFrame:
    """The first row of each text within the watermark; state is kept no longer than that."""
    return df.withColumn("hash", F.sha2(text, 256)).withWatermark(stamp, late).dropDuplicatesWithinWatermark(["hash"])


def windowed_counts(df: DataFrame, stamp: str, by: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of ``value`` per window, tumbling or sliding; later rows than the watermark are left out."""
    w = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return df.withWatermark(stamp, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(df: DataFrame, stamp: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: rows no further apart than the gap."""
    return df.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, to an in-memory table; for tests and small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
