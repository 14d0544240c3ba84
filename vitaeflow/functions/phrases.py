"""Phrases as data: a line as words between blanks, and tables of phrases that are looked up in it.

``spaced`` puts one blank on either side of each word, so that a phrase is a plain substring; no pattern per phrase is needed and
Spark keeps the look-up in generated code. Hyphens, slashes and other signs part words; an apostrophe joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}+#]+(?:'\p{L}+)?"


def words_of(text: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(F.translate(text, "’", "'")), F.lit(f"({WORD})"), 1)


def spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def spaced_text(text: Column) -> Column:
    return spaced(words_of(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used; Spark repeats it otherwise in each branch and lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a spaced text holds one of the phrases."""
    return reduce(lambda a, b: a | b, [text.contains(f" {p} ") for p in phrases])


def begins(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a spaced text begins with one of the phrases."""
    return reduce(lambda a, b: a | b, [text.startswith(f" {p} ") for p in phrases])


def after_last(text: Column, phrases: Iterable[str]) -> Column:
    """What of a spaced text follows the last of the phrases; all of it where none is there."""
    ends = [F.when(text.contains(f" {p} "), F.length(text) - F.locate(f" {p} "[::-1], F.reverse(text))) for p in phrases]
    return F.substr(text, F.coalesce(F.greatest(*ends), F.lit(0)) + 1)


def before_first(text: Column, phrases: Iterable[str]) -> Column:
    """What of a spaced text comes before the first of the phrases; all of it where none is there."""
    starts = [F.nullif(F.locate(f" {p} ", text), F.lit(0)) for p in phrases]
    return F.substr(text, F.lit(1), F.coalesce(F.least(*starts), F.length(text)))


def first_that(cases: Iterable[tuple[Column, object]]) -> Column:
    """The value of the first condition that holds, else null."""
    cases = list(cases)
    return reduce(lambda out, c: out.when(*c), cases[1:], F.when(*cases[0]))


def spaced_sql(text: str) -> str:
    """``spaced_text`` for DuckDB."""
    return rf"(' ' || array_to_string(regexp_extract_all(lower(translate({text}, '’', '''')), '{WORD.replace(chr(39), chr(39) * 2)}'), ' ') || ' ')"


def holds_sql(text: str, phrases: Iterable[str]) -> str:
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " OR ".join(f"contains({text}, ' {p} ')" for p in quoted) + ")"
