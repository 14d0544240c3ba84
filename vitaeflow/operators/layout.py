"""Reading order of two-column pages and boxes of highlighted words, out of tables of text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading_order(blocks: DataFrame, page: str = "page") -> DataFrame:
    """``page, ord, text``: header, left column, right column, footer, each from top to bottom.

    ``blocks`` has x0, y0, x1, y1, text, width, height. A block over 55 % of the width in the top quarter is header, in the
    lowest 15 % footer. A vertical line splits a page if no other block crosses it, both sides have blocks that overlap in height
    and their middles are 15 % of the width apart; of such lines the one with the widest distance counts. Candidate lines are fixed shares of
    the width and the middles between disjoint blocks of a page; a page's blocks meet only each other.
    """
    b = blocks.withColumn("wide", (F.col("x1") - F.col("x0")) > 0.55 * F.col("width"))
    band = F.when(F.col("wide") & (F.col("y1") <= 0.25 * F.col("height")), 0).when(F.col("wide") & (F.col("y0") >= 0.85 * F.col("height")), 3).otherwise(1)
    b = b.withColumn("band", band)
    body = b.where("band = 1")
    fixed = body.select(page, F.explode(F.array(*[F.col("width") * s for s in (0.33, 0.4, 0.5, 0.6, 0.67)])).alias("x")).distinct()
    left, right = body.select(page, "width", F.col("x1").alias("a")), body.select(page, F.col("x0").alias("z"))
    mids = left.join(right, page).where("a < z").select(page, ((F.col("a") + F.col("z")) / 2).alias("x"), "width").where("x between 0.2 * width and 0.8 * width").select(page, "x").distinct()
    lines = fixed.unionByName(mids).distinct()
    on = body.join(lines, page)
    side = lambda cond, c, f: f(F.when(cond, c))
    is_left, is_right = F.col("x1") <= F.col("x"), F.col("x0") >= F.col("x")
    s = on.groupBy(page, "x").agg(
        F.count(F.when(~is_left & ~is_right, 1)).alias("crossing"), F.count(F.when(is_left, 1)).alias("nl"), F.count(F.when(is_right, 1)).alias("nr"), F.max("width").alias("width"),
        side(is_left, (F.col("x0") + F.col("x1")) / 2, F.avg).alias("ml"), side(is_right, (F.col("x0") + F.col("x1")) / 2, F.avg).alias("mr"),
        side(is_left, F.col("y0"), F.min).alias("ly0"), side(is_left, F.col("y1"), F.max).alias("ly1"), side(is_right, F.col("y0"), F.min).alias("ry0"), side(is_right, F.col("y1"), F.max).alias("ry1"),
    )
    good = s.where("crossing = 0 and nl > 0 and nr > 0 and least(ly1, ry1) > greatest(ly0, ry0) and mr - ml >= 0.15 * width")
    best = good.groupBy(page).agg(F.max_by("x", F.struct(F.col("mr") - F.col("ml"), -F.col("x"))).alias("split"))
    j = b.join(best, page, "left").withColumn("part", F.when(F.col("band") != 1, F.col("band")).when(F.col("split").isNotNull() & (F.col("x0") >= F.col("split")), 2).otherwise(1))
    w = Window.partitionBy(page).orderBy("part", "y0", "x0", "text")
    return j.withColumn("ord", F.row_number().over(w)).select(page, "ord", "text")


def highlight_boxes(words: DataFrame, skills: DataFrame, page: str = "page", most: int = 200) -> DataFrame:
    """``page, skill, category, bx0, by0, bx1, by1``: words that are a skill of a category, as boxes in shares of the page.

    ``skills`` has skill and category; of several categories of a skill unverified comes before required before preferred. At most
    ``most`` boxes a page, in reading order, as a page that is drawn holds no more.
    """
    order = F.when(F.col("category") == "unverified", 0).when(F.col("category") == "required", 1).otherwise(2)
    one = skills.groupBy(F.lower("skill").alias("skill")).agg(F.min_by("category", order).alias("category"))
    bare = F.lower(F.regexp_replace("word", r"^[^\w+#]+|[^\w+#]+$", ""))
    unit = lambda a, b: F.round(F.least(F.greatest(F.col(a) / F.col(b), F.lit(0.0)), F.lit(1.0)), 5)
    j = words.withColumn("skill", bare).join(F.broadcast(one.limit(100_001)) if one.limit(100_001).count() <= 100_000 else one, "skill")
    boxes = j.select(page, "skill", "category", unit("x0", "width").alias("bx0"), unit("y0", "height").alias("by0"), unit("x1", "width").alias("bx1"), unit("y1", "height").alias("by1")).where("bx1 > bx0 and by1 > by0").distinct()
    w = Window.partitionBy(page).orderBy("by0", "bx0", "skill")
    return boxes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
