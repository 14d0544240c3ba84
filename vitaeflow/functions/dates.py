"""Months out of freely written dates, with built-in expressions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# First letters of month names in English, German, Spanish and French (accents removed).
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "apr": 4, "abr": 4, "avr": 4, "may": 5, "mai": 5,
    "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "ago": 8, "aou": 8, "sep": 9, "set": 9,
    "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "dic": 12,
}
# Words for an end that is still running.
RUNNING = (
    "present", "current", "currently", "to date", "till date", "until now", "today", "now", "ongoing", "to present",
    "heute", "bis heute", "aktuell", "actualidad", "actual", "hoy", "presente", "aujourd'hui", "actuel", "en cours",
)
# Words that open a period without an end, or part its two ends.
SINCE = r"^(?:since|from|seit|ab|desde|depuis)\s+"
ONWARDS = r"\s+(?:onwards?|on|to date|till date)$"
BETWEEN = r"\s+(?:[-\u2013\u2014]|to|until|till|through|bis|hasta|au)\s+"
YEAR_PIVOT = 50


def _clean(text: Column) -> Column:
    """Lower case, one kind of blank and apostrophe, no accents."""
    t = F.lower(F.trim(F.translate(text, "\u00a0\u2019`\u00b4", " '''")))
    return F.translate(t, "\u00e4\u00e1\u00e9\u00e8\u00ea\u00fb\u00f9\u00ed\u00f3\u00fa", "aaeeeuuiou")


def _year_first(t: Column) -> Column:
    """Each known form as ``yyyy-mm``, ``yyyy-name`` or ``yyyy``; two-digit years come out as ``yy``."""
    for pattern, form in (
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", "$3-$2-$1"),
        (r"^(\d{4})[/.-](\d{1,2})(?:[/.-](\d{1,2}))?$", "$1-$2-$3"),
        (r"^(\d{1,2})[/.-](\d{4})$", "$2-$1"),
        (r"^(?:\d{1,2}[a-z]{0,2}\.?\s+(?:de\s+)?)?([a-z]{3,12})[.,]{0,2}(?:\s+de)?[\s-]+(\d{4})$", "$2-$1"),
        (r"^([a-z]{3,12})\.?[\s-]*'?(\d{2})$", "$2-$1"),
    ):
        t = F.regexp_replace(t, pattern, form)
    return t


def _index(t: Column, end: Column, running: int | None) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTHS.items()))
    parts = F.split(_year_first(t), "-")
    written = parts.getItem(0).try_cast("int")
    year = F.when(written >= 100, written).when(written < YEAR_PIVOT, written + 2000).otherwise(written + 1900)
    name = F.try_element_at(parts, F.lit(2))
    number, day = name.try_cast("int"), F.try_element_at(parts, F.lit(3)).try_cast("int")
    month = F.coalesce(
        F.when((number > 12) & day.between(1, 12), day).otherwise(number),
        F.try_element_at(names, F.substring(name, 1, 4)),
        F.try_element_at(names, F.substring(name, 1, 3)),
        F.when(t.rlike(r"^\d{4}$"), F.when(end, 12).otherwise(1)),
    )
    out = F.when(month.between(1, 12) & t.rlike(r"\d{2}"), year * 12 + month - 1)
    return out if running is None else F.when(end & t.isin(*RUNNING), F.lit(running)).otherwise(out)


def month_indexes(start: Column, end: Column, running: int | None = None) -> Column:
    """``array(s, e)``: months since year 0 (``12 * year + month - 1``) of two written dates, null where none.

    A year alone is January, or December as the end; days are ignored; ``running`` is the index of an end
    that is written as still running (null: such words are no date). Day-first forms are read as such
    unless the second number can't be a month. Empty, blank and null texts give null.
    """
    # Lambdas, so that the long expression is there once for both ends and each step binds its input once.
    return F.transform(F.transform(F.array(start, end), _clean), lambda t, i: _index(t, i == 1, running))


def written_period(start: Column, end: Column, running: int) -> Column:
    """``array(s, e)`` of month indexes out of two text columns, of which the first may hold both ends."""
    low, second = F.lower(F.trim(start)), F.trim(end)
    alone = second.isNull() | (second == "")
    parts = F.split(low, BETWEEN)
    both = alone & (F.size(parts) == 2) & ~low.rlike(ONWARDS)
    opened = alone & ~both & (low.rlike(SINCE) | low.rlike(ONWARDS))
    bare = F.regexp_replace(F.regexp_replace(F.when(both, parts.getItem(0)).otherwise(low), SINCE, ""), ONWARDS, "")
    return month_indexes(bare, F.when(both, parts.getItem(1)).when(opened, F.lit(RUNNING[0])).otherwise(second), running)
