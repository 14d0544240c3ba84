"""Consensus of raters who disagree: accuracies by the triplet moment method, votes by log-odds weights.

A rater is one person of one panel. People use the scale differently, so each one's ratings are first read
by their rank within that person's ratings and set on the scale people usually use (the median of all
people's quantiles); a person who rates against all others is turned round. The ratings then are votes for a
band. Agreement of two people, corrected for chance, is the product of their accuracies above chance;
three such products give each accuracy. Votes are added with the log-odds of being right.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.operators.metrics import safe_corr
from vitaeflow.sources.scratch import cut_lineage

#: Lower bounds of the bands above the lowest.
BANDS = ((40.0, "moderate"), (70.0, "strong"))
LOWEST = "weak"
#: Steps of a rating that are told apart, and steps of quantiles: these bound the tables of one person.
STEPS, QUANTILES = 1000, 100
#: A vote is full where the rating is so far from the border of a band, and in proportion nearer to it.
BORDER = 12.0
#: Panels up to which their tables of 4 x (STEPS + 1) numbers are broadcast.
BROADCAST_PANELS = 500


def valid_ratings(df: DataFrame, raters: list[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """``df`` with ratings outside the scale, and NaN, as null."""
    return df.select(*[c for c in df.columns if c not in raters], *[F.when(F.col(r).between(low, high), F.col(r).cast("double")).alias(r) for r in raters])


def _histogram(df: DataFrame, panel: str, raters: list[str]) -> DataFrame:
    """``panel, r, bin, n, mid``: a person's ratings by value, with their mid-ranks in 0..1."""
    long = df.select(F.col(panel).alias("panel"), F.posexplode(F.array(*[F.round(F.col(r) * (STEPS / 100)).cast("int") for r in raters])).alias("r", "bin")).where("bin is not null")
    h = long.groupBy("panel", "r", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("panel", "r")
    before = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return h.withColumn("upto", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(w)).withColumn("mid", (F.col("upto") + F.col("n") / 2) / F.col("all"))


def _usual_scale(h: DataFrame) -> DataFrame:
    """One row ``scale array<double>``: the value at each quantile, the median over all people, each weighted by the
    root of the number of ratings, so that neither people with few ratings nor one with most of them settle it."""
    grid = h.select("panel", "r", "all", F.col("bin"), F.explode(F.expr(f"sequence(cast(ceil(upto * {QUANTILES} / all) as int), cast(ceil((upto + n) * {QUANTILES} / all) as int))")).alias("q"))
    each = grid.where(f"q <= {QUANTILES}").groupBy("panel", "r", "q").agg(F.avg("bin").alias("v"), F.ceil(F.sqrt(F.max("all"))).cast("bigint").alias("weight"))
    at = each.groupBy("q").agg((F.percentile("v", F.lit(0.5), F.col("weight")) * (100 / STEPS)).alias("v"))
    return at.agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda x: x.v).alias("scale"))


def _signs(df: DataFrame, panel: str, raters: list[str]) -> DataFrame:
    """``panel, signs array<int>``: -1 for a person whose ratings run against those of the others."""
    n = len(raters)
    pairs = {(i, j): f"c_{i}_{j}" for i in range(n) for j in range(i + 1, n)}
    shared = lambda i, j: F.when(F.col(raters[j]).isNotNull(), F.col(raters[i]))
    c = df.groupBy(F.col(panel).alias("panel")).agg(*[safe_corr(shared(i, j), shared(j, i)).alias(a) for (i, j), a in pairs.items()])
    value = {ij: F.coalesce(F.nanvl(F.col(a), F.lit(0.0)), F.lit(0.0)) for ij, a in pairs.items()}
    # Of all ways to turn people round (half of 2 ** n, for the columns of one table), the one with most agreement; the majority stays.
    patterns = [(1, *p) for p in itertools.product((1, -1), repeat=n - 1)]
    signs = [tuple(-x for x in p) if sum(p) < 0 else p for p in patterns]
    scored = [F.struct(F.round(sum((p[i] * p[j] * v for (i, j), v in value.items()), F.lit(0.0)), 9).alias("score"), F.lit(sum(s)).alias("kept"), F.array(*map(F.lit, s)).alias("signs")) for p, s in zip(patterns, signs)]
    return c.select("panel", F.array_max(F.array(*scored))["signs"].alias("signs"))


def band_of(value: Column) -> Column:
    out = F.when(value.isNull(), None)
    for bound, name in reversed(BANDS):
        out = out.when(value >= bound, name)
    return out.otherwise(LOWEST)


def _calibrated(df: DataFrame, key: str, panel: str, raters: list[str], spread) -> DataFrame:
    """``key, panel, t array<double>``: each row's ratings on the usual scale."""
    h = _histogram(df, panel, raters)
    n = len(raters)
    tables = (
        h.groupBy("panel", "r").agg(F.map_from_entries(F.collect_list(F.struct("bin", "mid"))).alias("m"))
        .groupBy("panel").agg(F.map_from_entries(F.collect_list(F.struct("r", "m"))).alias("ranks"))
        .join(_signs(df, panel, raters), "panel").crossJoin(F.broadcast(_usual_scale(h)))  # one row
    )
    per_panel = tables.select("panel", *[
        F.expr(f"transform_values(ranks[{i}], (b, u) -> scale[cast(round({QUANTILES} * if(signs[{i}] < 0, 1 - u, u)) as int)])").alias(f"m{i}") for i in range(n)
    ])
    rows = df.select(F.col(key).alias("key"), F.col(panel).alias("panel"), *[F.round(F.col(r) * (STEPS / 100)).cast("int").alias(f"b{i}") for i, r in enumerate(raters)])
    return rows.join(spread(per_panel), "panel").select("key", "panel", F.array(*[F.try_element_at(F.col(f"m{i}"), F.col(f"b{i}")) for i in range(n)]).alias("t"))


def rater_accuracies(t: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``panel, r, n_ratings, skill, accuracy, weight`` and ``panel, agreement`` (mean chance-corrected, by pairs).

    ``skill`` is the accuracy above chance: the square of a person's is c_ij * c_ik / c_jk, averaged over the
    pairs of others with weights c_jk ** 2. Where no two others agree beyond chance it is 0.
    """
    votes = t.select("panel", F.transform("t", band_of).alias("v"))
    pairs = votes.select("panel", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("v")[i].alias("a"), F.col("v")[j].alias("b")) for i in range(n) for j in range(i + 1, n)]))).where("a is not null and b is not null")
    cells = pairs.groupBy("panel", "i", "j", "a", "b").agg(F.count("*").alias("n"))
    w = lambda *c: Window.partitionBy("panel", "i", "j", *c)
    cells = cells.withColumn("all", F.sum("n").over(w())).withColumn("na", F.sum("n").over(w("a"))).withColumn("nb", F.sum("n").over(w("b")))
    same = F.col("a") == F.col("b")
    by_class = cells.groupBy("panel", "i", "j").agg(F.first("all").alias("all"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agree"), F.collect_set(F.struct("a", "na")).alias("sa"), F.collect_set(F.struct("b", "nb")).alias("sb"))
    chance = F.expr("aggregate(sa, 0D, (s, x) -> s + x.na * coalesce(aggregate(sb, 0L, (z, y) -> z + if(y.b = x.a, y.nb, 0L)), 0L))") / (F.col("all") * F.col("all"))
    c = by_class.withColumn("chance", chance).withColumn("c", F.when(F.col("chance") < 1, (F.col("agree") / F.col("all") - F.col("chance")) / (1 - F.col("chance"))).otherwise(0.0))
    agreement = c.groupBy("panel").agg((F.sum(F.col("c") * F.col("all")) / F.sum("all")).alias("agreement"))
    both = c.select("panel", "i", "j", "c", "chance").unionByName(c.select("panel", F.col("j").alias("i"), F.col("i").alias("j"), "c", "chance"))
    side = lambda x: both.select("panel", F.col("i").alias("i"), F.col("j").alias(x), F.col("c").alias(f"c{x}"))
    third = c.select("panel", F.col("i").alias("j"), F.col("j").alias("k"), F.col("c").alias("cjk"))
    triple = side("j").join(side("k"), ["panel", "i"]).where("j < k").join(third, ["panel", "j", "k"])
    skill = triple.groupBy("panel", "i").agg(F.sum(F.col("cj") * F.col("ck") * F.col("cjk")).alias("u"), F.sum(F.col("cjk") ** 2).alias("d"))
    skill = skill.select("panel", "i", F.when((F.col("d") > 1e-6) & (F.col("u") > 0), F.least(F.sqrt(F.col("u") / F.col("d")), F.lit(0.98))).otherwise(0.0).alias("skill"))
    rated = t.select("panel", F.posexplode("t").alias("i", "x")).where("x is not null").groupBy("panel", "i").agg(F.count("*").alias("n_ratings"))
    luck = both.groupBy("panel", "i").agg(F.avg("chance").alias("chance"))
    people = rated.join(skill, ["panel", "i"], "left").join(luck, ["panel", "i"], "left")
    # A panel of few items may agree by chance alone; the bounds keep its odds finite.
    s, p0, k = F.coalesce("skill", F.lit(0.0)), F.least(F.greatest(F.coalesce("chance", F.lit(1 / (len(BANDS) + 1))), F.lit(0.01)), F.lit(0.95)), len(BANDS)
    p = p0 + (1 - p0) * s
    # The floor keeps items that only poor raters have rated decidable.
    weight = F.greatest(F.log(p * k / (1 - p)) - F.log(p0 * k / (1 - p0)), F.lit(0.01))
    return people.select("panel", F.col("i").alias("r"), "n_ratings", s.alias("skill"), p.alias("accuracy"), weight.alias("weight")), agreement


def consensus(df: DataFrame, key: str, panel: str, raters: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(items, people, panels)``: ``key, band, agreement`` of each item with two or more valid ratings;
    ``rater_accuracies``; ``panel, agreement``.

    ``df`` has one row per item. Items without a panel form a panel of their own. At each border a vote above
    adds the person's weight, one below takes it away; ties go up. An item's agreement is its weights'
    share that voted for its band.
    """
    n = len(raters)
    df = valid_ratings(df.select(key, panel, *raters).withColumn(panel, F.coalesce(F.col(panel).cast("string"), F.lit(""))), raters)
    few = df.select(panel).distinct().limit(BROADCAST_PANELS + 1).count() <= BROADCAST_PANELS
    spread = F.broadcast if few else (lambda d: d)
    t = cut_lineage(_calibrated(df, key, panel, raters, spread))  # read for the accuracies and for the votes
    people, panels = rater_accuracies(t, n)
    weights = people.groupBy("panel").agg(F.map_from_entries(F.collect_list(F.struct("r", "weight"))).alias("w"))
    rated = t.join(spread(weights), "panel").where(F.size(F.filter("t", lambda x: x.isNotNull())) >= 2)

    def above(bound: float) -> Column:
        return F.expr(f"aggregate(transform(t, (x, i) -> coalesce(w[i] * greatest(-1D, least(1D, (x - {bound}D) / {BORDER}D)), 0D)), 0D, (s, x) -> s + x)") >= 0

    band = F.lit(LOWEST)
    for bound, name in BANDS:
        band = F.when(above(bound), name).otherwise(band)
    named = rated.withColumn("band", band).withColumn("votes", F.transform("t", band_of))
    share = F.expr("aggregate(transform(votes, (v, i) -> if(v = band, w[i], 0D)), 0D, (s, x) -> s + coalesce(x, 0D)) / aggregate(transform(votes, (v, i) -> if(v is null, 0D, w[i])), 0D, (s, x) -> s + x)")
    return named.select(F.col("key").alias(key), "band", F.round(share, 6).alias("agreement")), people, panels
