"""Evaluation: precision and recall, agreement, correlation, percentiles, grids over folds, confusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; 0 where a side doesn't vary or there is one row (``corr`` divides by zero there)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count("*") > 1) & (sx > 1e-9) & (sy > 1e-9), F.covar_pop(x, y) / (sx * sy)).otherwise(0.0)


def prf_micro_macro(counts: DataFrame) -> DataFrame:
    """``average, precision, recall, f1`` out of rows with tp, fp, fn; 0 where a denominator is 0."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    one = counts.select("tp", "fp", "fn", p.alias("p"), r.alias("r"), f1_of(p, r).alias("f"))
    a = one.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"))
    mp, mr = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    both = F.array(F.struct(F.lit("micro").alias("average"), mp.alias("precision"), mr.alias("recall"), f1_of(mp, mr).alias("f1")), F.struct(F.lit("macro").alias("average"), F.col("p").alias("precision"), F.col("r").alias("recall"), F.col("f").alias("f1")))
    return a.select(F.inline(both)).select("average", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def labels_against_found(labels: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """``key, tp, fp, fn`` by a full join of two sets of (key, item)."""
    j = labels.select(key, item).distinct().withColumn("l", F.lit(1)).join(found.select(key, item).distinct().withColumn("f", F.lit(1)), [key, item], "full_outer")
    return j.groupBy(key).agg(F.count(F.when(F.col("l").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("l").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))


def top_errors(errors: DataFrame, item: str, key: str, n: int = 15) -> DataFrame:
    """The n most frequent wrong items with the number of keys, ties by name."""
    c = errors.groupBy(item).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))
    return c.orderBy(F.desc("n"), item).limit(n)


def average_ranks(df: DataFrame, value: str, out: str, per: list[str]) -> DataFrame:
    """Ranks from 1 where equal values share their mean rank. Ranks come from counts of distinct values, so that only
    these are sorted in one task of a group."""
    c = df.groupBy(*per, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*per).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = c.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(r, [*per, value])


def correlation(df: DataFrame, a: str, b: str, per: list[str]) -> DataFrame:
    """``*per, n, mae, pearson, spearman``; correlations are 0 where a side doesn't vary or n < 2."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*per, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    r = average_ranks(average_ranks(d, "x", "rx", per), "y", "ry", per)
    return r.groupBy(*per).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mae"), F.round(safe_corr("x", "y"), 4).alias("pearson"), F.round(safe_corr("rx", "ry"), 4).alias("spearman"))


def rater_pairs(df: DataFrame, key: str, raters: list[str], per: list[str]) -> DataFrame:
    """``*per, a, b, n, mad, pearson`` for each pair of raters; from the wide row, without a self-join."""
    pairs = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x in enumerate(raters) for y in raters[i + 1 :]])
    long = df.select(*per, F.inline(pairs)).where("x is not null and y is not null")
    return long.groupBy(*per, "a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mad"), F.round(safe_corr("x", "y"), 4).alias("pearson"))


def anchors(df: DataFrame, value: str, human: str, weak: float = 30.0, strong: float = 70.0) -> DataFrame:
    """``low, high``: the 5th percentile of ``value`` among weak rows, the 95th among strong ones; exact, interpolated."""
    return df.agg(F.round(F.percentile(F.when(F.col(human) < weak, F.col(value)), F.lit(0.05)), 4).alias("low"), F.round(F.percentile(F.when(F.col(human) > strong, F.col(value)), F.lit(0.95)), 4).alias("high"))


def fold_of(key: Column, folds: int = 5) -> Column:
    """A fold by a hash of the key, the same in every run; rows of one key never part."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % folds


def grid_search(features: DataFrame, key: str, a: str, b: str, human: str, weights: list[float], lows: list[float], highs: list[float], folds: int = 5) -> DataFrame:
    """``w, low, high, cv_mae``: mean over folds of the mean error of ``(1 - w) * a + w * norm(b)`` for each setting.

    The grid is a small literal table broadcast to the rows; rows x settings are reduced to (setting, fold) before the shuffle.
    """
    spark = features.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(w), float(lo), float(hi)) for w in weights for lo in lows for hi in highs], "w double, low double, high double"))
    norm = F.least(F.greatest((F.col(b) - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0))
    e = features.select(key, a, b, human, fold_of(F.col(key), folds).alias("fold")).crossJoin(grid).withColumn("err", F.abs(100 * ((1 - F.col("w")) * F.col(a) + F.col("w") * norm) - F.col(human)))
    return e.groupBy("w", "low", "high", "fold").agg(F.avg("err").alias("mae")).groupBy("w", "low", "high").agg(F.round(F.avg("mae"), 4).alias("cv_mae"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def top_confusions(df: DataFrame, actual: str, predicted: str, n: int = 5) -> DataFrame:
    """``actual, predicted, n``: the n most frequent mix-ups of two labels, ties by name."""
    c = confusion(df.where(F.col(actual) != F.col(predicted)), actual, predicted)
    return c.orderBy(F.desc("n"), "actual", "predicted").limit(n)


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of each label that is actual or predicted; from the confusion counts."""
    c = confusion(df, actual, predicted)
    long = c.select(F.inline(F.array(F.struct(F.col("actual").alias("label"), F.lit(0).alias("s"), F.col("n"), (F.col("actual") == F.col("predicted")).alias("ok")), F.struct(F.col("predicted").alias("label"), F.lit(1).alias("s"), F.col("n"), F.lit(False).alias("ok")))))
    s = long.groupBy("label").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") == 0, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("s") == 1, F.col("n")).otherwise(0)).alias("found"))
    p, r = ratio(F.col("tp"), F.col("found")), ratio(F.col("tp"), F.col("support"))
    return s.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1_of(p, r), 4).alias("f1"), "support")


def paired_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, mean, se, low, high, t, p, w, p_signed``: the mean difference with its 95 % interval by Student's distribution, the paired t-test, and Wilcoxon's
    signed-rank test (the smaller rank sum; normal approximation with ties, differences of 0 left out). Probabilities are two-sided; null where nothing varies."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se")).first()
    n, mean, se = s["n"], s["mean"], s["se"]
    q = student_quantile(0.975, n - 1) if n > 1 else 0.0
    t = mean / se if se else None
    p = None if t is None else 2 * (1 - student_cdf(abs(t), n - 1))
    ranked = average_ranks(d.where("d <> 0").select("d", F.abs("d").alias("size"), F.lit(0).alias("g")), "size", "r", ["g"])
    ties = ranked.groupBy("size").agg(F.count("*").cast("double").alias("c")).agg(F.coalesce(F.sum(F.col("c") ** 3 - F.col("c")), F.lit(0.0)).alias("ties"))
    r = ranked.agg(F.count("*").alias("m"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("minus")).first()
    m, w = r["m"], float(min(r["plus"], r["minus"]))
    spread = math.sqrt(max(0.0, m * (m + 1) * (2 * m + 1) / 24 - ties.first()["ties"] / 48))
    signed = math.erfc(abs(w - m * (m + 1) / 4) / spread / math.sqrt(2)) if spread else None
    row = (n, *(None if x is None else round(float(x), 4) for x in (mean, se, None if se is None else mean - q * se, None if se is None else mean + q * se, t, p, w, signed)))
    return df.sparkSession.createDataFrame([row], "n bigint, mean double, se double, low double, high double, t double, p double, w double, p_signed double")


def student_cdf(t: float, dof: int) -> float:
    """Student's distribution function, summed in closed form for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(dof))
    if dof % 2:
        s = theta + (math.sin(theta) * _series(dof, theta) if dof > 1 else 0.0)
        return 0.5 + s / math.pi
    return 0.5 + 0.5 * math.sin(theta) * _series(dof, theta)


def student_quantile(p: float, dof: int) -> float:
    """By bisection of the distribution function."""
    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _series(dof: int, theta: float) -> float:
    odd, c = dof % 2, math.cos(theta)
    term, total = (c if odd else 1.0), (c if odd else 1.0)
    for k in range(3 if odd else 2, dof - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return total


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share`` with nulls as a value."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(null)")).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # total: one row


def uncertainty(df: DataFrame, probability: str, actual: str, predicted: str, least: float = 0.35) -> DataFrame:
    """Rows below the least probability, and the accuracy of the others."""
    sure = F.col(probability) >= least
    return df.agg(F.count("*").alias("n"), F.count(F.when(~sure, 1)).alias("uncertain"), F.round(F.avg(F.when(sure, (F.col(actual) == F.col(predicted)).cast("double"))), 4).alias("accuracy_sure"))

