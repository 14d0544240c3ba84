"""Several values packed in one field: the delimiter-and-quote dialect of each cell by minimum description length.

Every cell is parsed under each dialect that fits it. A parse costs the bits of its values plus the bits
that name its dialect. A value's bits come from a code book of value counts over the whole table
(``-log2`` of its share), else from its letters. The cheapest parse is the cell's. A first book counts the
values of all parses, later ones those of the cheapest parses only, so that fragments of names that contain
a separator themselves lose their code.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.sources.scratch import cut_lineage

#: Bits of the longest codes of a book: values with a smaller share of all values are spelled. There can be no more than 2 ** 20 entries,
#: which bounds what is sent to the driver and the tasks, whatever the table's size.
BOOK_BITS = 20
#: Entries with a separator inside are also recognised with small edits if their code has at most so many bits
#: (by their share there can be no more than 2 ** 13 of them) and they aren't such a variant of a more frequent one.
COMPOUND_BITS = 13
#: Values whose bits a task remembers; bounds memory only.
MEMO = 200_000
#: A separator inside a spelled value is rarer than a letter.
LETTER_BITS, SEPARATOR_BITS, VALUE_BITS, EDIT_BITS = 4.7, 10.0, 4.0, 9.0

_BLANK = " \t\r\n\u00a0\u2009\u202f\ufeff"
_MARK = re.compile(r"^(?:[-*\u2022\u00b7\u2013\u25aa\u25cf\u2023]+(?=\s)|[\u2022\u25aa\u25cf\u2023\u00b7]+|\(\d{1,3}\)|\d{1,3}[.)](?=\s))[\s\u00a0]*")
_NUMBERED = re.compile(r"(?:^|(?<=\s))(?:\((\d{1,3})\)|(\d{1,3})[.)])[\s\u00a0]+")
_SEPARATOR = re.compile(r"[,;|/&\t\n\u00b7\u2022]|\s\+\s")
_INNER = re.compile(r"[,;|/&+\t\n\u00b7\u2022]|\band\b")
#: The delimiters of the dialects, as patterns; white space around them belongs to them.
DELIMITERS = {
    "semicolon": ";", "comma": ",", "bar": r"\|", "tab": r"\t", "line": r"\n", "slash": "/", "spaced slash": r"\s/(?=\s)", "plus": r"\s\+(?=\s)",
    "dot": r"\s\u00b7(?=\s|$)", "bullet": "\u2022", "ampersand": r"\s&(?=\s)", "and": r"\sand(?=\s)", "mixed": r"[;,|\t\n]", "wide": r"[;,|\t\n\u00b7\u2022]|\s[/+](?=\s)",
}
_SPLIT = {k: re.compile(v) for k, v in DELIMITERS.items()}
_LAST = re.compile(r",?\s(?:and|&)\s")


def bare(value: str) -> str:
    """Without outer blanks, list marks and quotes that enclose the whole value."""
    v = value.strip(_BLANK)
    v = _MARK.sub("", v).strip(_BLANK)
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'" and v[0] not in v[1:-1].replace(v[0] * 2, ""):
        v = v[1:-1].replace(v[0] * 2, v[0]).strip(_BLANK)
    return v.rstrip("\u2022\u00b7" + _BLANK)


def code_key(value: str) -> str:
    """The form under which a value is counted."""
    return " ".join(value.lower().split())


def _quoted_split(text: str, pattern: re.Pattern) -> list[str]:
    """Split outside double quotes; a quote counts only at the start of a value; doubled ones stay inside."""
    out, start, i = [], 0, 0
    while i <= len(text):
        m = re.compile(r"\s*\"").match(text, i) if i == start else None
        if m and (close := re.compile(r"(?:[^\"\\]|\"\"|\\.)*\"(?=\s*(?:$|" + pattern.pattern.replace(r"(?=\s)", "").replace(r"(?=\s|$)", "") + "))").match(text, m.end())):
            i = close.end()
        cut = pattern.search(text, i)
        if not cut:
            out.append(text[start:])
            break
        out.append(text[start : cut.start()])
        start = i = cut.end()
    return out


def _listed(text: str) -> list[str] | None:
    """The values of a bracketed or braced list, unescaped; None where it isn't one."""
    t = text.strip(_BLANK)
    if len(t) < 2 or t[0] + t[-1] not in ("[]", "{}", "()"):
        return None
    if t[0] in "[(":
        for read in (json.loads, ast.literal_eval):
            try:
                x = read(t)
                if isinstance(x, (list, tuple)):
                    return ["" if v is None else str(v) for v in x]
            except Exception:  # noqa: BLE001 - any text may stand here
                pass
    parts = _quoted_split(t[1:-1], _SPLIT["comma"])
    return [re.sub(r"\\(.)", r"\1", bare(p)) if p.strip(_BLANK)[:1] == '"' else p for p in parts]


def candidate_parses(text: str) -> list[tuple[str, list[str]]]:
    """The distinct parses of one cell as (dialect, values); the first is the cell as one value."""
    found: dict[tuple, str] = {}

    def add(name: str, parts: list[str]) -> None:
        values = tuple(v for v in map(bare, parts) if v)
        if values:
            found.setdefault(values, name)

    add("whole", [text.strip(_BLANK + ";|,")])
    if (items := _listed(text)) is not None:
        values = tuple(v for v in (x.strip(_BLANK) for x in items) if v)
        if values:
            found.setdefault(values, "list")
    marks = list(_NUMBERED.finditer(text))
    if marks and not text[: marks[0].start()].strip(_BLANK) and [int(m[1] or m[2]) for m in marks] == list(range(1, len(marks) + 1)):
        ends = [m.start() for m in marks[1:]] + [len(text)]
        add("numbered", [text[m.end() : e] for m, e in zip(marks, ends)])
    for name, pattern in _SPLIT.items():
        if not pattern.search(text):
            continue
        parts = _quoted_split(text, pattern)
        add(name, parts)
        kept = [p for p in parts if p.strip(_BLANK)]
        if name in ("comma", "semicolon", "mixed") and kept:
            tail = re.sub(r"^\s*(?:and|&)\s", "", kept[-1])
            if tail != kept[-1]:
                add(name + " with first word", kept[:-1] + [tail])
            for m in _LAST.finditer(tail):
                add(name + " with last", kept[:-1] + [tail[: m.start()], tail[m.end() :]])
    return [(name, list(values)) for values, name in found.items()]


@dataclass
class CodeBook:
    """Value counts of a table; ``compounds`` are the entries with a separator inside."""

    counts: dict[str, int] = field(default_factory=dict)
    total: int = 0

    def __post_init__(self) -> None:
        self.compounds, self._words, self._bits = [], [], {}
        self._segments, self._sizes, self._by_words = defaultdict(list), set(), defaultdict(list)
        for k in self.counts:  # most frequent first
            if _INNER.search(k) and self.code(k) <= COMPOUND_BITS and not any(True for _ in self._near(k)):
                at, parts = len(self.compounds), _edits_of(k) + 1
                self.compounds.append(k)
                self._words.append(frozenset(re.findall(r"[^\W_]{3,}", k)))
                self._by_words[_bag(k)].append(at)
                # Of so many segments one must stand in a text unchanged that holds the entry with its edits.
                for i in range(parts):
                    seg = k[i * len(k) // parts : (i + 1) * len(k) // parts]
                    self._segments[seg].append(at)
                    self._sizes.add(len(seg))

    def code(self, key: str) -> float:
        return -math.log2((self.counts[key] + 0.5) / (self.total + 1))

    def bits(self, value: str) -> float:
        key = code_key(value)
        if (b := self._bits.get(value)) is None:
            apart = len(_SEPARATOR.findall(value))
            b = VALUE_BITS + LETTER_BITS * (len(key) - apart) + SEPARATOR_BITS * apart
            if key in self.counts:
                b = min(b, self.code(key) + b / self.counts[key])  # its share of spelling the entry once
            elif _INNER.search(key):
                b = min([b, *self._near(key)])
            if len(self._bits) < MEMO:
                self._bits[value] = b
        return b

    def _near(self, key: str) -> Iterator[float]:
        """Costs of the value as a compound entry with edits and letters added; they share a word or have close lengths.

        Entries are found by a segment that the value holds, or by having the same words."""
        words = frozenset(re.findall(r"[^\W_]{3,}", key))
        if len(key) <= max(map(len, self.compounds), default=0) + 60:
            held = {key[i : i + n] for n in self._sizes for i in range(len(key) - n + 1)}
            found = {at for seg in held & self._segments.keys() for at in self._segments[seg]}
        else:
            found = set()
        same = set(self._by_words.get(_bag(key), ()))
        for at in sorted(found | same):
            name, own = self.compounds[at], self._words[at]
            if len(key) > len(name) + 60:  # so much more to spell that the entry inside hardly shortens it
                continue
            if words & own or abs(len(key) - len(name)) <= 3:
                edits = _within(name, key)
                if edits <= _edits_of(name):
                    yield self.code(name) + EDIT_BITS * edits + LETTER_BITS * max(0, len(key) - len(name))
                elif at in same:
                    yield self.code(name) + EDIT_BITS


def _edits_of(name: str) -> int:
    return max(1, len(name) // 5)


def _bag(name: str) -> tuple:
    return tuple(sorted(re.findall(r"\w+|&", name)))


def _within(needle: str, text: str) -> int:
    """Smallest edit distance between the needle and a stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(needle, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def cheapest_parse(text: str, book: CodeBook) -> tuple[str, list[str]]:
    """The parse of least bits; of equals the one with fewer values, then the earlier one."""
    parses = candidate_parses(text)
    low = text.lower()
    if len(low) == len(text) and (inside := [c for c in book.compounds if c in low and c != low]):
        # The same dialects, with the separators inside known names hidden.
        hidden = list(text)
        for name in inside:
            at = low.find(name)
            while at >= 0:
                hidden[at : at + len(name)] = [chr(0xE000 + ord(c)) if ord(c) < 256 and not c.isalnum() else c for c in hidden[at : at + len(name)]]
                at = low.find(name, at + len(name))
        shown = {0xE000 + i: chr(i) for i in range(256)}
        parses += [(n, values) for n, vs in candidate_parses("".join(hidden)) if (values := [v.translate(shown) for v in vs]) not in [p for _, p in parses]]
    if not parses:
        return "whole", []
    name_bits = math.log2(len(DELIMITERS) + 3)

    def cost(parse: tuple[str, list[str]]) -> tuple[float, int]:
        name, values = parse
        rare = name in ("wide", "mixed") or name.startswith("mixed ")
        return sum(map(book.bits, values)) + (0 if name == "whole" else name_bits if rare else 2) + (3 * LETTER_BITS if rare and name.endswith("word") else 0), len(values)

    return min(parses, key=cost)


def _values_of(column: str, book: CodeBook | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                if text is None:
                    continue
                parses = candidate_parses(text) if book is None else [cheapest_parse(text, book)]
                values = {code_key(v) for _, vs in parses for v in vs}
                out += [*values, *[None] * len(values)]  # nulls count all values
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def fit_code_book(df: DataFrame, column: str, rounds: int = 2) -> CodeBook:
    """Value counts over all cells; each round is one pass with a combined count, of which the driver receives the total and the values whose
    codes have at most ``BOOK_BITS`` bits. A value that occurs once costs its spelling in either way and is left out."""
    cells, book = df.select(F.col(column).alias("cell")), None
    for _ in range(rounds):
        counts = cells.mapInArrow(_values_of("cell", book), "value string").groupBy("value").count().where("count > 1")
        counts = cut_lineage(counts)
        total = counts.where("value is null").agg(F.sum("count")).first()[0] or 0
        rows = counts.where(F.col("value").isNotNull() & (F.col("count") * (1 << BOOK_BITS) >= total)).orderBy(F.desc("count"), "value").collect()
        book = CodeBook({r["value"]: r["count"] for r in rows}, total)
    return book


def split_packed(df: DataFrame, column: str, into: str, book: CodeBook) -> DataFrame:
    """``df`` with ``into array<string>``: the values of each cell in their order under its cheapest dialect.

    Null cells give a null array, empty and blank ones an empty array. A column that already has the name
    ``into`` is replaced. Cells are independent: no shuffle.
    """
    df = df.drop(into)
    at = df.columns.index(column)
    shared = df.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else cheapest_parse(t, shared.value)[1] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, into])

    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])
    return df.mapInArrow(run, schema)
