"""Freely typed values to the entries of a reference list: a partition-based pigeonhole join, in SQL only.

A reference string cut into k + 1 segments shares at least one whole segment with any string within k edits, near
its own place. So segments and positional substrings meet in an equality join, and the built-in
``levenshtein`` verifies. Values that stay are compared word by word, where a word may be shortened. What
then has no entry is reported by an anti-join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.sources.scratch import broadcaster, cut_lineage

#: Forms of reference entries up to which what is derived from them is broadcast: of a form about a hundred short keys.
SMALL_LIST = 5_000

# Letters of other scripts that look like Latin ones.
_ALIKE = dict(zip("аеорсхуіјѕвкмнтԁɡοαρν", "aeopcxyijsbkmhtdgoapv"))
_ALIKE |= {"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "s"}
# By rule: accented Latin letters and their base letters.
_ALIKE |= {chr(c): b[0] for c in range(0xC0, 0x250) if chr(c) == chr(c).lower() and (b := unicodedata.normalize("NFKD", chr(c)))[0].isascii() and b[0].isalpha()}
_FROM, _TO = "".join(_ALIKE), "".join(_ALIKE.values())

# What may be added to a value without changing its entry.
_BEFORE = (
    r"(?:senior|sr|junior|jr|lead|principal|acting|interim|deputy|associate|basic|advanced|intermediate|expert|certified|good|strong|some)\.?\s+"
    r"|(?:exp|experience|experienced|skilled|knowledge|proficient|proficiency|skills?)\.?\s+(?:in|of|with)\s+"
    r"|(?:b\.?\s?sc|m\.?\s?sc|b\.?\s?a|m\.?\s?a|b\.?\s?eng|m\.?\s?eng|ph\.?\s?d|mba|hnd|bachelor'?s?|master'?s?|diploma|degree|associate'?s?)\.?(?:\s+degree)?\s+(?:in|of)\s+"
    r"|(?:dept|department|faculty|school|institute)\.?\s+of\s+|(?:major|minor|field|subject)\s*:\s*"
)
#: A degree in front without a word that joins it.
_DEGREE = r"^(?:b\.?sc|m\.?sc|b\.?a|m\.?a|b\.?eng|m\.?eng|ph\.?d|mba|hnd)\.?\s+"
_AFTER = (
    r"(?:contract(?:or)?|freelance|part[- ]?time|full[- ]?time|temp(?:orary)?|permanent|fixed[- ]term|remote|hybrid|on-?site|night shift|day shift|shift work"
    r"|[mfwdx](?:/[mfwdx]){1,2}|minor|major|honou?rs|hons|(?:1st|2nd|3rd|first|second|third) class|advanced|basic|intermediate|beginner|expert|studies|skills?"
    r"|level \d|grade \d|i{1,3}|iv|v\d+|\d+\+?\s*(?:yrs?|years?)(?: exp(?:erience)?)?|acting|interim|senior|junior)"
)


def plain(value: Column) -> Column:
    """Lower case in plain Latin letters, without list signs around it and additions before and after it."""
    t = F.translate(F.lower(value), _FROM + "   _’", _TO + "    '")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[​-‏﻿­]", ""), r"\s+", " "))
    t = F.regexp_replace(t, rf"^(?:{_BEFORE}){{1,2}}", "")
    return F.regexp_replace(t, rf"(?:(?:\s*[-,(@–]\s*|\s+){_AFTER}\)?){{1,2}}\*?$", "")


def _words(text: Column) -> Column:
    """Words of letters and digits; an apostrophe joins, ``&`` is dropped, a capital letter splits nothing."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(text, "'", ""), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def _allowed(size: Column) -> Column:
    """Edits looked for at a reference string of so many letters; one more is allowed where the letters without their
    order need no more, since two letters swapped are two edits."""
    return F.when(size < 6, 1).when(size < 12, 2).otherwise(3)


def reference_forms(refs: DataFrame, kind: str, ref_id: str, canonical: str) -> DataFrame:
    """``kind, ref_id, words, s, k``: each entry with its words rotated, forwards and backwards."""
    w = _words(plain_reference(F.col(canonical)))
    turns = lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.concat(F.slice(a, i, F.size(a)), F.slice(a, F.lit(1), i - 1)))
    forms = (
        refs.where(F.col(canonical).isNotNull() & F.col(ref_id).isNotNull()).select(F.col(kind).alias("kind"), F.col(ref_id).alias("ref_id"), w.alias("w"))
        .where(F.size("w") > 0)
        .select("kind", "ref_id", F.explode(F.array_distinct(F.concat(turns(F.col("w")), turns(F.reverse("w"))))).alias("words"))
    )
    # All words but the last by their initials, as one word.
    initials = F.expr("array(array_join(transform(slice(w, 1, size(w) - 1), x -> left(x, 1)), ''), element_at(w, -1))")
    short = refs.where(F.col(canonical).isNotNull() & F.col(ref_id).isNotNull()).select(F.col(kind).alias("kind"), F.col(ref_id).alias("ref_id"), w.alias("w")).where("size(w) > 2")
    s = forms.unionByName(short.select("kind", "ref_id", initials.alias("words"))).withColumn("s", F.array_join("words", ""))
    return s.withColumn("k", _allowed(F.length("s")))


def plain_reference(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(value), _FROM, _TO), r"\s+", " "))


#: Letters of a segment that go into a join key. A segment that holds an edit-free stretch holds one at its start too.
_KEY_LETTERS = 12


def _bound(i: str, n: str, k: str, shift: str) -> str:
    """Where segment ``i`` of k + 1 starts, in letters from 0; inner bounds are moved by ``shift``."""
    return f"cast(floor(({i}) * {n} / ({k} + 1)) as int) + if({i} between 1 and {k}, {shift}, 0)"


def _segment_keys(s: str, k: str, cuts: int = 1) -> str:
    """SQL for the keys ``n:cut:i:segment`` of the k + 1 segments of string ``s`` of n letters. With two ``cuts`` the string is cut a second
    time, one letter further, so that two swapped letters lie within a segment of one of them."""
    n = f"length({s})"
    size = f"least({_KEY_LETTERS}, {_bound('i + 1', n, k, 'cut')} - ({_bound('i', n, k, 'cut')}))"
    return (
        f"flatten(transform(sequence(0, {cuts - 1}), cut -> transform(filter(sequence(0, {k}), i -> {size} > 0), i ->"
        f" concat_ws(':', {n}, cut, i, substring({s}, {_bound('i', n, k, 'cut')} + 1, {size})))))"
    )


def _substring_keys(s: str, edits: str, reach: int, cuts: int = 1) -> str:
    """SQL for the keys that a value ``s`` may share with a reference string: for each length n that one may have, at most ``reach`` from
    the value's, and each of its segments, the substrings where that segment can stand: with j edits before it at most j places off, and with the
    others after it. Swapped letters move nothing. ``edits`` is the number of edits by ``n``; none where it is null."""
    size = f"least({_KEY_LETTERS}, {_bound('i + 1', 'n', edits, 'cut')} - ({_bound('i', 'n', edits, 'cut')}))"
    start = f"({_bound('i', 'n', edits, 'cut')} + d)"
    low, high = f"greatest(-i, length({s}) - n - {edits} + i)", f"least(i, length({s}) - n + {edits} - i)"
    return (
        f"flatten(transform(filter(sequence(greatest(length({s}) - {reach}, 1), length({s}) + {reach}), n -> {edits} is not null and abs(length({s}) - n) <= {edits}), n ->"
        f" flatten(transform(sequence(0, {cuts - 1}), cut -> flatten(transform(filter(sequence(0, {edits}), i -> {low} <= {high} and {size} > 0), i ->"
        f" transform(filter(sequence({low}, {high}), d -> {start} >= 0 and {start} + {size} <= length({s})), d -> concat_ws(':', n, cut, i, substring({s}, {start} + 1, {size})))))))))"
    )


_LETTERS = "array_join(array_sort(split({0}, '')), '')"


def edit_candidates(strings: DataFrame, forms: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``kind, s, ref_id, r, k``, distinct: strings and reference strings that share a segment at its place."""
    edits = "case when n < 6 then 1 when n < 12 then 2 else 3 end"
    refs = forms.select("kind", "ref_id", F.col("s").alias("r"), "k", F.expr(f"explode({_segment_keys('s', 'k', 2)})").alias("key"))
    return strings.select("kind", "s", F.expr(f"explode({_substring_keys('s', edits, 3, 2)})").alias("key")).join(spread(refs), ["kind", "key"]).select("kind", "s", "ref_id", "r", "k").distinct()


# What a typed word may be of a reference word: the beginning of it, a shortening that keeps its first letter and the
# order of the others, a word with few edits, or its beginning with few edits; null where it is none of these.
def _word_cost(w: str, r: str, many: str) -> str:
    return (
        f"case when {w} = {r} then 0D"
        f" when length({w}) >= 2 and startswith({r}, {w}) and ({many} or length({w}) >= 4) then 0.5D"
        f" when {many} and length({w}) between 2 and length({r}) - 2 and left({w}, 1) = left({r}, 1) and {r} rlike concat('^', regexp_replace({w}, '(.)', '$1.*')) then 0.75D"
        f" when length({r}) >= 4 and levenshtein({w}, {r}) <= if(length({r}) < 6, 1, 2) then cast(levenshtein({w}, {r}) as double)"
        f" when length({w}) >= 4 and length({r}) > length({w}) and levenshtein({w}, left({r}, length({w}))) <= if(length({w}) < 7, 1, 2) then 1.5D end"
    )


def word_candidates(typed: DataFrame, known: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``w, r``, distinct: typed and reference words that may stand for each other, by equality joins.

    Beginnings meet on their first six letters, shortenings on their first letter and two that follow it in order
    (on all of it, where it has two), words with edits and beginnings with edits on a segment at its place.
    """
    edits, start_edits = "case when n < 4 then null when n < 6 then 1 else 2 end", "case when n < 4 then null when n < 7 then 1 else 2 end"
    named = lambda name, keys: f"transform({keys}, x -> concat('{name}', x))"
    left = f"concat(array(concat('p', left(w, 6)), concat('s', left(w, 3))), {named('e', _substring_keys('w', edits, 2))}, {named('b', _substring_keys('w', start_edits, 0))})"
    # Of a reference word: where each letter after the first stands first and last; its beginnings of four letters or more.
    spots = "transform(filter(array_distinct(split(substring(r, 2), '')), c -> c <> ''), c -> named_struct('c', c, 'first', locate(c, r, 2), 'last', length(r) + 1 - locate(c, reverse(r))))"
    short = "concat(flatten(transform(spots, a -> transform(filter(spots, b -> b.last > a.first), b -> concat('s', left(r, 1), a.c, b.c)))), transform(spots, a -> concat('s', left(r, 1), a.c)))"
    begun = f"flatten(transform(if(length(r) > 4, sequence(4, length(r) - 1), array()), m -> {_segment_keys('left(r, m)', 'if(m < 7, 1, 2)')}))"
    whole = _segment_keys("r", "if(length(r) < 6, 1, 2)")
    long = f"concat({named('e', whole)}, {named('b', begun)}, {short})"
    right = f"concat(transform(sequence(1, least(6, length(r))), n -> concat('p', left(r, n))), if(length(r) > 3, {long}, array()))"
    w = typed.select("w").distinct().select("w", F.expr(f"explode({left})").alias("key"))
    r = known.select("r").distinct().select("r", F.expr(spots).alias("spots")).select("r", F.expr(f"explode({right})").alias("key"))
    return w.join(spread(r), "key").select("w", "r").distinct()


def _best(found: DataFrame) -> DataFrame:
    """One entry per value: the least cost, then the smallest id."""
    return found.groupBy("kind", "raw").agg(F.min(F.struct("cost", "ref_id")).alias("m")).select("kind", "raw", F.col("m.ref_id").alias("ref_id"), F.col("m.cost").alias("cost"))


def _shortened(values: DataFrame, forms: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values whose words are, one by one, a form's words, some shortened, some with few edits.

    Typed words first meet reference words (``word_candidates``). A value then meets the forms that begin, after turning, with
    words its own two longest neighbouring words may stand for, so that pairs grow with what matches; all other words are verified.
    """
    turned = F.expr("concat(slice(words, at, size(words)), slice(words, 1, at - 1))")
    # Forms hold all turns of an entry's words, so that a value may be turned to have its longest pair in front.
    at = F.expr("if(size(words) < 3, 1, array_max(transform(words, (x, i) -> named_struct('n', length(x) + length(words[(i + 1) % size(words)]), 'i', -i))).i * -1 + 1)")
    v = values.where("size(words) > 0").withColumn("at", at).select("kind", "raw", "penalty", turned.alias("words"))
    words = v.select(F.explode(F.slice("words", 1, 2)).alias("w"))
    f = forms.select("kind", "ref_id", F.col("words").alias("r"))
    known = f.select(F.explode("r").alias("r")).distinct()
    fits = word_candidates(words, known, spread).where(_word_cost("w", "r", "true") + " is not null")
    fits = cut_lineage(fits)
    second = F.coalesce(F.get("words", F.lit(1)), F.lit(""))
    v = v.withColumn("w1", F.get("words", F.lit(0))).withColumn("w2", second).withColumn("m", F.size("words"))
    f = f.withColumn("r1", F.get("r", F.lit(0))).withColumn("r2", F.coalesce(F.get("r", F.lit(1)), F.lit(""))).withColumn("m", F.size("r"))
    # The pairs of words in use, with what they may stand for.
    one, two = fits.select(F.col("w").alias("w1"), F.col("r").alias("r1")), fits.select(F.col("w").alias("w2"), F.col("r").alias("r2"))
    pairs = v.select("kind", "m", "w1", "w2").distinct().join(one, "w1")
    pairs = pairs.where("m > 1").join(two, "w2").unionByName(pairs.where("m = 1").withColumn("r2", F.lit("")))
    meets = pairs.join(spread(f.select("kind", "m", "r1", "r2").distinct()), ["kind", "m", "r1", "r2"])
    met = v.join(meets, ["kind", "m", "w1", "w2"]).join(spread(f), ["kind", "m", "r1", "r2"])
    cost = F.expr(f"transform(arrays_zip(words, r), x -> {_word_cost('x.words', 'x.r', 'size(r) > 1')})")
    total = met.withColumn("c", cost).where("not exists(c, x -> x is null)").withColumn("cost", F.expr("aggregate(c, 0D, (s, x) -> s + x)") + F.col("penalty"))
    best = total.groupBy("kind", "raw", "ref_id").agg(F.min("cost").alias("cost"))
    ranked = best.withColumn("least", F.min("cost").over(Window.partitionBy("kind", "raw"))).where("cost = least")
    alone = ranked.groupBy("kind", "raw").agg(F.count("*").alias("n"), F.min("ref_id").alias("ref_id"), F.min("cost").alias("cost"))
    return alone.where("n = 1").select("kind", "raw", "ref_id", "cost")


def map_to_canonical(values: DataFrame, refs: DataFrame, kind: str = "kind", ref_id: str = "ref_id", canonical: str = "canonical") -> DataFrame:
    """``kind, raw, ref_id`` of each distinct (kind, raw) of ``values``; ``ref_id`` 0: no entry fits.

    Null and blank values are left out. A value that fits several entries equally well gets the smallest id
    by edits, and none by shortened words. With an empty list all values get 0. Derived reference tables
    are broadcast where ``SMALL_LIST`` rows are counted or fewer, and else joined by shuffle.
    """
    distinct = values.select(F.col("kind"), F.col("raw")).where(F.trim("raw") != "").distinct()
    # Further forms, at a cost: with what looks like an addition, without what follows a comma, bracket or
    # dash, and without a first word that is nearly one of the additions.
    whole, before = plain(F.col("raw")), plain_reference(F.regexp_replace(F.translate("raw", "_", " "), r"[​-‏﻿­]", ""))
    head = F.regexp_extract(before, r"^([a-z]{4,9})\s+\S", 1)
    slip = F.exists(F.array(*map(F.lit, ("basic", "senior", "junior", "acting", "advanced"))), lambda d: (head != "") & (F.levenshtein(head, d) <= 2))
    form = lambda t, cost: F.struct(t.alias("t"), F.lit(cost).alias("penalty"))
    forms = F.array_compact(F.array(
        form(whole, 0.0), form(before, 0.25), form(F.regexp_replace(before, rf"^(?:{_BEFORE}){{1,2}}", ""), 0.25),
        F.when(before.rlike(_DEGREE), form(F.regexp_replace(whole, _DEGREE, ""), 0.5)),
        form(F.regexp_replace(whole, r"^(.{3,}?)(?:\s*[,(@]|\s[-–]\s).*$", "$1"), 1.0), F.when(slip, form(F.regexp_replace(before, r"^\S+\s+", ""), 1.5)),
    ))
    typed = distinct.select("kind", "raw", F.inline(forms)).withColumn("words", _words(F.col("t"))).withColumn("s", F.array_join("words", ""))
    typed = typed.where("length(s) > 1").groupBy("kind", "raw", "s").agg(F.min(F.struct("penalty", "words")).alias("m")).select("kind", "raw", "s", "m.penalty", "m.words")
    typed = cut_lineage(typed)  # distinct values in their forms; four joins start here
    ref = cut_lineage(reference_forms(refs, kind, ref_id, canonical))
    spread = broadcaster(ref, SMALL_LIST)

    exact = cut_lineage(_best(typed.join(spread(ref.select("kind", "s", "ref_id").distinct()), ["kind", "s"]).select("kind", "raw", "ref_id", F.col("penalty").alias("cost"))))
    rest = cut_lineage(typed.join(exact.select("kind", "raw"), ["kind", "raw"], "left_anti"))
    # A plain string may come from many values; it goes through the join once.
    met = edit_candidates(rest.select("kind", "s").distinct(), ref, spread)
    letters = f"levenshtein({_LETTERS.format('s')}, {_LETTERS.format('r')})"
    near = met.withColumn("d", F.expr("levenshtein(s, r, 4)")).where(f"d >= 0 and (d <= k or d <= k + 1 and {letters} <= k)").groupBy("kind", "s", "ref_id").agg(F.min("d").alias("d"))
    edits = rest.join(near, ["kind", "s"]).select("kind", "raw", "ref_id", (F.col("d") + F.col("penalty")).alias("cost"))
    close = cut_lineage(_best(_best(edits).unionByName(_shortened(rest, ref, spread))))

    mapped = exact.select("kind", "raw", "ref_id").unionByName(close.select("kind", "raw", "ref_id"))
    none = distinct.join(mapped, ["kind", "raw"], "left_anti").withColumn("ref_id", F.lit(0).cast(mapped.schema["ref_id"].dataType))
    return mapped.unionByName(none)
