"""Cleaning, lines, sections and chunks of document texts. Row-wise built-in expressions; nothing is shuffled."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# Typographic characters and their plain forms.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "•": "-", "‣": "-", "■": "-", "●": "-", "…": "..."}
# Section headings of a resume.
SECTIONS = {
    "education": ("education", "academic background", "academics", "qualifications", "academic qualifications", "educational background", "education and certifications", "education & certifications", "education and training"),
    "experience": ("work experience", "professional experience", "experience", "employment history", "work history", "career history", "employment", "projects", "freelance experience", "freelance work", "work", "job history"),
    "other": ("skills", "technical skills", "certifications", "licenses", "publications", "awards", "languages", "interests", "references", "summary", "profile"),
}


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form, which Spark SQL lacks; Arrow batches."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean_line(line: Column) -> Column:
    """One line: runs of blanks and tabs as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), r"^ | $", "")


def light_clean(text: Column) -> Column:
    """Control characters dropped (line ends and tabs stay), plain typography, no rule lines, one blank between
    words, at most one empty line in a row. Null and blank texts give null. Apply ``nfkc`` before for the
    compatibility form."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    single = {k: v for k, v in PLAIN.items() if len(v) == 1}
    t = F.translate(t, "".join(single), "".join(single.values()))
    for k, v in PLAIN.items():
        if len(v) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    kept = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^[-=*_~#]{3,}[ \t]*$"))
    t = F.array_join(F.transform(kept, clean_line), "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.nullif(t, F.lit(""))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: the non-empty lines, cleaned, numbered from 1 by their place in the text."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("p", "l")).select(key, (F.col("p") + 1).alias("line_no"), clean_line(F.col("l")).alias("line")).where("line <> ''")


def section_of(line: Column) -> Column:
    """The section a heading line opens, else null: it equals a heading or is one with a colon."""
    h = F.regexp_replace(F.lower(line), r":.*$", "")
    out = F.when(h.isin(*SECTIONS["education"]), "education")
    for name in ("experience", "other"):
        out = out.when(h.isin(*SECTIONS[name]), name)
    return out.otherwise(None)


def with_sections(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with ``section`` (of the last heading so far, 'head' before any) and ``is_heading``."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = section_of(F.col("line"))
    return lines.withColumn("own", own).withColumn("section", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("head"))).withColumn("is_heading", F.col("own").isNotNull()).drop("own")


def sentence_chunks(text: Column, least: int = 15, short: int = 35) -> Column:
    """Array of sentence-like chunks: lines without bullets, split after ``.!?``; a piece shorter than ``least`` joins the
    chunk before it where that is shorter than ``short``, stands alone as the very first, and is dropped otherwise."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(clean_line(x), r"^(?:[-*•]|\d{1,2}[.)]|[a-zA-Z]\))\s+", ""))
    pieces = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    pieces = F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^[\s\-•*]+|[\s\-•*]+$", "")), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, x)))
        return (
            F.when(F.length(x) >= least, F.concat(acc, F.array(x)))
            .when((F.size(acc) > 0) & (F.length(last) < short), joined)
            .when(F.size(acc) == 0, F.array(x)).otherwise(acc)
        )

    return F.when(text.isNotNull(), F.aggregate(pieces, empty, fold))


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def title_case(text: Column) -> Column:
    """A capital after anything that isn't a letter, as in ``Ci/Cd``; lower case elsewhere."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def name_from_file(filename: Column) -> Column:
    """A person's name out of a file name: no extension, copies, resume words or numbers; words in title case."""
    s = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    s = F.regexp_replace(s, r"\s*(?:\(\d+\)|\[\d+\]|\{\d+\})", "")
    s = F.regexp_replace(s, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"[_\-.+]+", " ")
    words = F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~F.lower(w).isin("resume", "cv", "curriculum", "vitae", "final", "updated", "new", "copy", "request"))
    return F.nullif(title_case(F.array_join(words, " ")), F.lit(""))


def duration_text(months: Column) -> Column:
    """``2 yrs 4 mos``; ``None`` for null and what isn't positive."""
    y, m = F.floor(months / 12), months % 12
    unit = lambda n, one: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {one}s"))
    return F.when(months > 0, F.concat_ws(" ", F.when(y > 0, unit(y, "yr")), F.when(m > 0, unit(m, "mo")))).otherwise("None")
