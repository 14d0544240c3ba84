"""Dated experience written in resume lines: ranges, titles and companies, months by kind of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.functions.dates import MONTHS, month_indexes
from vitaeflow.functions.phrases import bound, holds, spaced_text
from vitaeflow.operators.profile import bucket_of, degree_of, merged_months

# What stands between the two dates of a range, what opens a range without end, and words for an end still running.
RANGE_SIGNS = ("-", "/", "to", "until", "till")
OPENERS = ("since", "from")
STILL = ("present", "current", "now", "ongoing", "active", "today", "to date", "till date")
# Words that job titles end in or hold.
TITLE_WORDS = (
    "engineer", "developer", "architect", "manager", "lead", "director", "consultant", "analyst", "designer", "specialist", "intern", "trainee", "associate", "officer", "administrator", "scientist", "programmer", "coordinator",
    "head", "vp", "president", "technician",
)
#: What a line is cut into: names of months and other words, numbers with a slash or hyphen before a year, and signs.
_TOKEN = r"[\p{L}]+[.]?|[0-9]{1,2}[/-][0-9]{4}|[0-9]+|[^\p{L}0-9\s]"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, "–—’", "--'"), F.lit(f"({_TOKEN})"), 1)


def _date_at(t: Column, i: Column, back: bool) -> Column:
    """The written date whose last token (``back``) or first token is at ``i``: a year with a month before it, a month with slash or a year; else ''."""
    at = lambda k: F.coalesce(F.when(i + k > 0, F.try_element_at(t, F.greatest(i + k, F.lit(1)))), F.lit(""))
    one = at(0)
    year = one.rlike("^[12][0-9]{3}$")
    month = lambda x: F.substring(F.lower(x), 1, 3).isin(*MONTHS) & x.rlike("^[A-Za-z]+[.]?$")
    numbered = one.rlike("^(0?[1-9]|1[0-2])[/-][12][0-9]{3}$")
    if back:
        named = year & (month(at(-1)) | ((at(-1) == "'") & month(at(-2))))
        name = F.when(at(-1) == "'", at(-2)).otherwise(at(-1))
        return F.when(named, F.concat_ws(" ", name, one)).when(year | numbered, one).otherwise("")
    after = F.when(at(1) == "'", at(2)).otherwise(at(1))
    return F.when(month(one) & after.rlike("^[12][0-9]{3}$"), F.concat_ws(" ", one, after)).when(year | numbered, one).otherwise("")


def ranges_in(line: Column) -> Column:
    """``array<struct<start, end, first, last>>``: the ranges a line writes, with the tokens they begin and end at. Both ends may be written in
    different ways; 'since' and 'from' before a date that no range goes on from run until now."""

    def found(t: Column) -> Column:
        low = lambda i: F.lower(F.coalesce(F.try_element_at(t, i), F.lit("")))

        def ranged(i: Column) -> Column:
            sign = low(i).isin(*RANGE_SIGNS)
            twice = sign & low(i + 1).isin(*RANGE_SIGNS)  # as in "- to"
            begin, nxt = F.when(i > 1, _date_at(t, i - 1, True)).otherwise(""), F.when(twice, i + 2).otherwise(i + 1)
            running = low(nxt).isin(*STILL) | F.concat_ws(" ", low(i), low(i + 1)).isin(*STILL) | F.concat_ws(" ", low(nxt), low(nxt + 1)).isin(*STILL)
            end = F.when(running, F.lit("present")).otherwise(_date_at(t, nxt, False))
            return F.when(sign & (begin != "") & (end != ""), F.struct(begin.alias("start"), end.alias("end"), (i - F.size(F.split(begin, " "))).alias("first"), (nxt + F.size(F.split(end, " ")) - 1).alias("last")))

        def opened(i: Column) -> Column:
            begin = _date_at(t, i + 1, False)
            after = i + 1 + F.size(F.split(begin, " "))
            return F.when(low(i).isin(*OPENERS) & (begin != "") & ~low(after).isin(*RANGE_SIGNS), F.struct(begin.alias("start"), F.lit("present").alias("end"), i.alias("first"), (after - 1).alias("last")))

        places = F.sequence(F.lit(1), F.size(t))
        return F.when(F.size(t) > 0, F.array_compact(F.concat(F.transform(places, ranged), F.transform(places, opened))))

    return F.flatten(F.transform(F.array(_tokens(line)), lambda t: F.coalesce(found(t), F.array())))


def _titled(text: Column) -> Column:
    return bound(spaced_text(F.coalesce(text, F.lit(""))), lambda words: holds(words, TITLE_WORDS))


def dated_lines(lines: DataFrame, key: str, running: int) -> DataFrame:
    """``key, line_no, range_no, title, company, s, e, bucket, is_internship, confidence``: the ranges of lines outside education.

    Title and company are what stands before the first date, parted by a bar, 'at' or a comma; where nothing does, they are looked for in the two lines before, back to a heading or a dated line.
    ``confidence`` is high where months are written at both ends, medium where an end is a year alone, low where no title is found. Dates that don't parse, and ends before starts, give no row.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    d = lines.withColumn("ranges", ranges_in(F.col("line"))).withColumn("stop", (F.size("ranges") > 0) | F.col("is_heading"))
    free = lambda n: F.when(~F.coalesce(F.lag("stop", n).over(w), F.lit(True)), F.lag("line", n).over(w))
    d = d.withColumn("one", free(1)).withColumn("two", F.when(F.col("one").isNotNull(), free(2)))
    d = d.where((F.size("ranges") > 0) & (F.col("section") != "education") & degree_of(F.col("line")).isNull())
    d = d.withColumn("rest", F.array_join(F.slice(_tokens(F.col("line")), F.lit(1), F.greatest(F.col("ranges")[0]["first"] - 1, F.lit(0))), " "))
    # The words before the first date as they are written.
    words = F.size(F.regexp_extract_all("rest", F.lit("([\\p{L}0-9]+)"), 1))
    head = F.regexp_replace(F.regexp_extract("line", r"^(.*?)(?:\b(?:since|from)\b|\(|\||,|[-–—])?\s*(?:\p{L}{3,9}[.]?\s+'?[12]\d{3}|\d{1,2}[/-][12]\d{3}|[12]\d{3})", 1), r"^\W+|[\s(|,–—-]+$", "")
    own = F.when((words > 0) & (F.length(head) > 3), head)
    halves = F.split(F.coalesce(own, "one"), r"\s*\|\s*|\s+at\s+|,\s+", 2)
    a, b = F.trim(halves[0]), F.trim(F.try_element_at(halves, F.lit(2)))
    above = own.isNull() & F.col("two").isNotNull() & b.isNull()
    a, b = F.when(above, F.col("two")).otherwise(a), F.when(above, F.col("one")).otherwise(b)
    swap = _titled(b) & ~_titled(a)
    d = d.withColumn("b", bucket_of(F.concat_ws(" ", "two", "one", "line")))
    e = d.select(key, "line_no", F.when(swap, b).otherwise(a).alias("title"), F.when(swap, a).otherwise(b).alias("company"), F.posexplode("ranges").alias("range_no", "r"), "b")
    i = month_indexes(F.col("r.start"), F.col("r.end"), running)
    monthly = ~F.col("r.start").rlike("^[0-9]{4}$") & ~F.col("r.end").rlike("^[0-9]{4}$")
    confidence = F.when(F.coalesce("title", F.lit("")) == "", "low").when(monthly, "high").otherwise("medium")
    out = e.select(key, "line_no", (F.col("range_no") + 1).alias("range_no"), "title", "company", F.inline(F.array(F.struct(i.alias("i")))), "b", confidence.alias("confidence"))
    return out.select(key, "line_no", "range_no", "title", "company", F.col("i")[0].alias("s"), F.col("i")[1].alias("e"), "b.bucket", "b.is_internship", "confidence").where("s <= e")


def months_by_bucket(entries: DataFrame, key: str) -> DataFrame:
    """``key, bucket, months``: professional, freelance, full-time (professional without internships) and internship; an entry may count in several."""
    kinds = F.array_compact(F.array(F.col("bucket"), F.when((F.col("bucket") == "professional") & ~F.col("is_internship"), "full_time"), F.when(F.col("is_internship"), "internship")))
    return merged_months(entries.select(key, F.explode(kinds).alias("bucket"), "s", "e"), [key, "bucket"], "s", "e")


# Words that aren't part of a person's name.
NOT_NAMES = r"(?i)\b(?:resume|cv|curriculum|vitae|profile|summary|objective|experience|education|skills?|contact|address|phone|email|engineer|developer|manager|analyst|designer|consultant|university|college|page)\b"


def name_in_head(text: Column, filename_name: Column) -> Column:
    """The first of the five top lines that looks like a name (two to four capitalised words, nothing else); else the name in the file name."""
    top = F.slice(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    likely = F.filter(top, lambda x: x.rlike(r"^(?:\p{Lu}[\p{L}'’.-]*)(?:\s+(?:van|der|de|la|von|bin|al|\p{Lu}[\p{L}'’.-]*)){1,4}$") & ~x.rlike(NOT_NAMES))
    return F.coalesce(F.try_element_at(likely, F.lit(1)), filename_name)


def random_window(text: Column, key: Column, size: int = 25) -> Column:
    """``size`` words from a place drawn by a hash of the key; shorter texts whole. For stress tests of classifiers."""
    words = F.split(text, r"\s+")
    start = F.pmod(F.xxhash64(key.cast("string")), F.greatest(F.size(words) - size + 1, F.lit(1))).cast("int") + 1
    return F.array_join(F.slice(words, start, size), " ")
