"""Joins whose keys may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.sources.scratch import cut_lineage

#: A key with at least this part of all rows is hot; there can be no more such keys than its inverse.
HOT_SHARE = 1 / 1000


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``lookup``, an inner join by ``keys``; ``lookup`` has one row a key.

    ``weight`` is the column of ``lookup`` with the number of rows each key has; it isn't kept. Hot keys, of which there
    are at most ``1 / HOT_SHARE``, are broadcast and joined where their rows are; all others by shuffle, where no
    key weighs enough to fill a task. Null keys match nothing. ``lookup`` is read three times: it should be a checkpoint.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= max(1.0, total * HOT_SHARE)
    hot, cold = lookup.where(is_hot).drop(weight), lookup.where(~is_hot).drop(weight)
    bounded = F.broadcast(hot)  # at most 1 / HOT_SHARE rows, by arithmetic
    here = rows.join(bounded, keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.unionByName(there)


def pairs_in_blocks(members: DataFrame, group: str, item: str, block: int = 500) -> DataFrame:
    """``group, x, y`` with ``x < y``: all pairs of items within each group.

    For results that must hold every pair. A group of n items is cut into blocks of about ``block`` items by hash, and each
    pair of blocks is a key of its own, so that a task gets at most ``block ** 2`` pairs of a group at once however large it is. Each item
    is copied ``n / block`` times. Groups and items that are null give nothing; repeated rows must be dropped before.
    """
    m = cut_lineage(members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")))
    sizes = cut_lineage(m.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").withColumn("b", F.ceil(F.col("n") / block).cast("int")))
    sized = join_lookup(m, sizes, ["g"], "n").withColumn("own", F.pmod(F.xxhash64("i"), F.col("b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
    meeting = sized.select("g", "i", "own", other.alias("o")).select("g", "i", "own", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"))
    # In a block pair (p, q) with p < q an item meets those of the other block only; in (p, p) all of its own.
    left = meeting.where("own = p").select("g", "p", "q", F.col("i").alias("x"))
    right = meeting.where("own = q").select("g", "p", "q", F.col("i").alias("y"))
    met = left.join(right, ["g", "p", "q"]).where("p < q or x < y")
    return met.select(F.col("g").alias(group), F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

