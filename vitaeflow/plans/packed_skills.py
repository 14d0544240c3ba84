"""The packed skill cells of the label tables, one value per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.operators.packed import fit_code_book, split_packed
from vitaeflow.sources.scratch import cut_lineage, spread_out
from vitaeflow.sources.tables import latest_by_key, read_table

#: (table, packed column, stamp)
CELLS = (("skill_eval_template", "true_skills", "labelled_at"), ("skill_eval_results", "false_positives", "evaluated_at"))


def packed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, resume_id, cell`` of both tables, each key once."""
    parts = []
    for table, column, stamp in CELLS:
        t = latest_by_key(read_table(spark, folder, table).select("resume_id", F.col(column).alias("cell"), stamp), "resume_id", stamp)
        parts.append(t.select(F.lit(column).alias("field_name"), "resume_id", "cell"))
    return reduce(DataFrame.unionByName, parts)


def split_cells(spark: SparkSession, folder: str, cells: tuple = CELLS) -> DataFrame:
    """``packed_cells`` with ``items``, parsed with one code book of all columns."""
    # Each key once: a repeated row would make its whole cell look like a value. Three passes read what is written here.
    every = cut_lineage(spread_out(packed_cells(spark, folder)))
    return split_packed(every.where(F.col("field_name").isin(*[c for _, c, _ in cells])), "cell", "items", fit_code_book(every, "cell"))


def split_packed_column(spark: SparkSession, folder: str, table: str, column: str, stamp: str) -> DataFrame:
    """``split_cells`` of one of the columns, parsed as in ``p3_found``."""
    return split_cells(spark, folder, ((table, column, stamp),))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, resume_id, pos, item_value``: every value of each cell with two or more values."""
    many = split_cells(spark, folder).where(F.size("items") > 1)
    return many.select("field_name", "resume_id", F.posexplode("items").alias("pos", "item_value")).withColumn("pos", (F.col("pos") + 1).cast("int"))
