"""Evaluation texts inside training text: CGK embedding, bit sampling over windows, exact edit check.

CGK's random walk reads a window word by word: at step t it writes the current word and moves on where a
random bit of (t, word) says so. Two windows a few edits apart fall back into step, so that their walks agree
at most steps. Each repetition has its own walk and samples some steps; a corpus window and an item
window that agree on all of them are a candidate. A candidate counts if a stretch of the document around it
follows a stretch of the item within the allowed edits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.sources.scratch import cut_lineage

#: Shortest stretch in words, and the words for which one edit is allowed.
STRETCH, WORDS_PER_EDIT = 15, 8
#: Repetitions, steps of a walk, and steps sampled in each repetition.
TABLES, STEPS, SAMPLED = 48, 26, 8
#: Words of items up to which their index is sent to the tasks; the windows of more items are a table, which windows of the corpus are joined to.
INDEX_WORDS = 2_000_000
#: Bits of the filter of item word pairs in that case; a fuller filter lets more windows through and loses none.
FILTER_BITS, FILTER_BLOCKS = 1 << 27, 256
_SEED = 20240607

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower case, without accents' encodings, markup and hidden characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


@dataclass
class Index:
    """Item windows: for each repetition the sorted keys and the windows they belong to."""

    vocabulary: dict[str, int]
    symbols: np.ndarray
    words: np.ndarray
    item_of: np.ndarray
    first: dict[int, int]
    last: dict[int, int]
    bits: np.ndarray
    keys: list[np.ndarray]
    windows: list[np.ndarray]
    pairs: np.ndarray


_WALK = np.random.default_rng(_SEED)
#: By rule: the steps each repetition samples, and the numbers that make its random bits out of a word's hash.
SAMPLES = np.array([np.sort(_WALK.choice(STEPS, SAMPLED, replace=False)) for _ in range(TABLES)])
_TURNS = _WALK.integers(1, 2**63, (TABLES, STEPS), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _step_bits(symbols: np.ndarray, r: int, t: int) -> np.ndarray:
    """The random bits of step ``t`` of repetition ``r`` for words given by hash; 0 is a word that no item has."""
    return (_mixed(symbols ^ _TURNS[r, t]) >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def _walk(words: np.ndarray, starts: np.ndarray, bits: np.ndarray, r: int, symbols: np.ndarray) -> np.ndarray:
    """The sampled symbols of the walks from ``starts``, as one key each; ``words`` index ``symbols`` and ``bits[t]``."""
    at, key, wanted = starts.copy(), np.full(len(starts), r, np.uint64), set(SAMPLES[r].tolist())
    for t in range(int(SAMPLES[r].max()) + 1):
        s = words[at]
        if t in wanted:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbols[s] + np.uint64(1))
        at += bits[t, s]
    return key


def build_index(items: list[tuple[int, str | None]]) -> Index:
    """Items with fewer than ``STRETCH`` words can't occur as a stretch and are left out."""
    vocabulary: dict[str, int] = {}
    words, owner, first, last = [], [], {}, {}
    for item, text in sorted((i, t) for i, t in items if t):
        w = words_of(text)
        if len(w) < STRETCH:
            continue
        first[item] = len(words)
        words += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in w]
        last[item] = len(words)
        words += [0] * STEPS
        owner += [item] * (len(w) + STEPS)
    flat, item_of = np.array(words, np.int64), np.array(owner, np.int64)
    starts = np.concatenate([np.arange(first[i], last[i] - STRETCH + 1) for i in first]) if first else np.empty(0, np.int64)
    symbols = np.concatenate([np.zeros(1, np.uint64), word_hashes(list(vocabulary))])
    bits = np.array([[_step_bits(symbols, r, t) for t in range(STEPS)] for r in range(TABLES)], np.int8)
    keys, windows = [], []
    for r in range(TABLES):
        k = _walk(flat, starts, bits[r], r, symbols)
        order = np.argsort(k, kind="stable")
        keys.append(k[order])
        windows.append(starts[order])
    pairs = np.zeros(1 << min(26, int(64 * len(flat)).bit_length()), bool)
    pairs[_pair_slots(flat, len(pairs))] = True
    return Index(vocabulary, symbols, flat, item_of, first, last, bits, keys, windows, pairs)


def _pair_slots(words: np.ndarray, slots: int) -> np.ndarray:
    """A slot for each pair of neighbours; pairs that share one only let more windows through."""
    return (words[:-1] * 1_000_003 + words[1:]) % slots


def _enough_pairs(words: np.ndarray, starts: np.ndarray, x: Index) -> np.ndarray:
    """Where so many of the pairs of neighbours in a window are pairs of items that the allowed edits can have broken the others; an edit breaks two."""
    known = np.concatenate(([0], np.cumsum(x.pairs[_pair_slots(words, len(x.pairs))] & (words[:-1] > 0) & (words[1:] > 0))))
    return known[starts + STRETCH - 1] - known[starts] >= STRETCH - 1 - 2 * ((STRETCH + 1) // WORDS_PER_EDIT)


def _enough(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where so many of the next ``STRETCH`` words are known from items that the others can be edits."""
    known = np.concatenate(([0], np.cumsum(words > 0)))
    return known[np.minimum(starts + STRETCH, len(words))] - known[starts] >= STRETCH - 1 - (STRETCH + 1) // WORDS_PER_EDIT


def candidates(words: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """(corpus positions, item positions) of windows that agree in some repetition.

    Only windows whose numbers of words and of pairs known from items leave room for the allowed edits are embedded.
    """
    if len(words) <= STEPS or not len(x.first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.arange(len(words) - STEPS)
    starts = starts[_enough(words, starts) & (words[starts] > 0)]
    starts = starts[_enough_pairs(words, starts, x)]
    found = []
    for r in range(TABLES):
        k = _walk(words, starts, x.bits[r], r, x.symbols)
        lo, hi = np.searchsorted(x.keys[r], k, "left"), np.searchsorted(x.keys[r], k, "right")
        hit = np.flatnonzero(hi > lo)
        n = hi[hit] - lo[hit]
        if len(hit):
            at = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(starts[hit], n), x.windows[r][at]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def aligned_starts(words: np.ndarray, at: np.ndarray, there: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions around candidate windows, those where so many of the next ``STRETCH`` words stand near
    the same place of the item that the others can be edits, with a position inside that item."""
    shift = np.arange(-STRETCH - 1, 3)
    big = np.int64(len(x.words) + 1)
    s, q = (at[:, None] + shift).ravel(), (there[:, None] + shift).ravel()
    inside = (s >= 0) & (s < len(words))
    s, q, home = s[inside], q[inside], np.repeat(there, len(shift))[inside]
    _, one = np.unique(s * big * 2 + q + STEPS, return_index=True)
    s, q, home = s[one], q[one], home[one]
    ok = _enough(words, s)
    s, q, home = s[ok], q[ok], home[ok]
    drift = 2 * ((STRETCH + 1) // WORDS_PER_EDIT)
    pad = np.concatenate([np.zeros(2 * STEPS, np.int64), x.words, np.zeros(2 * STEPS, np.int64)])
    edits, good = (STRETCH + 1) // WORDS_PER_EDIT, np.zeros(len(s), bool)
    for a in range(0, len(s), 200_000):
        part = slice(a, a + 200_000)
        hits = np.zeros(len(s[part]), np.int8)
        for k in range(STRETCH):
            w, at_item, near = words[np.minimum(s[part] + k, len(words) - 1)], q[part] + k + 2 * STEPS, np.zeros(len(s[part]), bool)
            for d in range(-drift, drift + 1):
                near |= pad[at_item + d] == w
            hits += near & (w > 0)
        good[part] = hits >= STRETCH - 1 - edits
    return s[good], home[good]


def follows(doc: np.ndarray, starts: np.ndarray, item: np.ndarray) -> bool:
    """Does some stretch of ``doc`` from one of ``starts`` follow a stretch of ``item``? Exact.

    Lengths up to twice the shortest are enough: of a longer stretch, one half allows its own edits.
    """
    cols = np.arange(len(item) + 1)
    d = np.zeros((len(starts), len(item) + 1), np.int32)
    padded = np.concatenate([doc, np.full(2 * STRETCH + 1, -1)])
    for n in range(1, 2 * STRETCH + 1):
        at = np.minimum(starts + n - 1, len(padded) - 1)
        w = padded[at]
        new = d + 1
        np.minimum(new[:, 1:], d[:, :-1] + (item[None, :] != w[:, None]), out=new[:, 1:])
        d = np.minimum.accumulate(new - cols, axis=1) + cols
        inside = starts + n <= len(doc)
        if n >= STRETCH and (d[inside].min(axis=1, initial=n) <= n // WORDS_PER_EDIT).any():
            return True
    return False


def leaks_of(texts: list[str | None], x: Index) -> list[tuple[int, int]]:
    """(index of the text, item id) of all leaks in a batch of texts."""
    get, parts, bounds = x.vocabulary.get, [], [0]
    gap = [0] * STEPS
    for t in texts:
        ids = [get(w, 0) for w in words_of(t)] if t else []
        parts += ids
        parts += gap
        bounds.append(len(parts))
    words = np.array(parts + gap, np.int64)
    starts, there = aligned_starts(words, *candidates(words, x), x)
    doc = np.searchsorted(bounds, starts, "right") - 1
    item = x.item_of[there]
    out = []
    order = np.lexsort((starts, item, doc))
    doc, item, starts = doc[order], item[order], starts[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0)))) if len(doc) else []
    for a, b in zip(cut, [*cut[1:], len(doc)]):
        lo, hi = bounds[doc[a]], bounds[doc[a] + 1] - STEPS
        if follows(words[lo:hi], np.unique(starts[a:b]) - lo, x.words[x.first[item[a]] : x.last[item[a]]]):
            out.append((int(doc[a]), int(item[a])))
    return out


def _window_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``TABLES`` keys of each window; ``words`` are hashes followed by ``STEPS`` zeros."""
    symbols, ids = np.unique(words, return_inverse=True)
    out = np.empty((len(starts), TABLES), np.uint64)
    for r in range(TABLES):
        bits = np.array([_step_bits(symbols, r, t) for t in range(STEPS)])
        out[:, r] = _walk(ids, starts, bits, r, symbols)
    return out


def _pair_bits(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(FILTER_BITS)).astype(np.int64)


def _pair_filter(items: DataFrame) -> np.ndarray:
    """A bit for each pair of neighbouring words of an item: built in the tasks and combined block by block, so that the driver receives
    ``FILTER_BITS`` bits however many items there are."""
    size = FILTER_BITS // 8 // FILTER_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                at = _pair_bits(np.array(words, np.int64).view(np.uint64))
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        blocks = own.reshape(FILTER_BLOCKS, size)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "bits"])

    def combined(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        for b in part["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"block": [key[0]], "bits": [out.tobytes()]})

    parts = items.select("words").mapInArrow(run, "block int, bits binary").groupBy("block").applyInPandas(combined, "block int, bits binary")
    whole = np.zeros((FILTER_BLOCKS, size), np.uint8)
    for row in parts.collect():  # at most FILTER_BLOCKS rows
        whole[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.ravel()


def _search_joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``h, i``: the leaks of ``items`` (i, t) in the texts of ``docs`` (h, t), for any number of items, in one pass over the texts.

    Item windows are a table with a key for each repetition. Windows of texts pass if ten of their fourteen pairs of words are pairs of some item,
    as they must with two edits, and meet item windows by an equality join on the keys. What met is checked exactly.
    """

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, word_hashes(w).view(np.int64)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and len(w := words_of(t)) >= STRETCH]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["i", "words"])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(words, np.int64).view(np.uint64)
                keys = np.unique(_window_keys(np.concatenate([w, np.zeros(STEPS, np.uint64)]), np.arange(len(w) - STRETCH + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), i, np.int64))], ["key", "i"])

    def text_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(words_of(t))
                if len(w) < STRETCH:
                    continue
                at = _pair_bits(w)
                known = np.concatenate(([0], np.cumsum(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
                starts = np.arange(len(w) - STRETCH + 1)
                starts = starts[known[starts + STRETCH - 1] - known[starts] >= STRETCH - 1 - 2 * ((STRETCH + 1) // WORDS_PER_EDIT)]
                if len(starts):
                    keys = np.unique(_window_keys(np.concatenate([w, np.zeros(STEPS, np.uint64)]), starts))
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(keys), pa.string()), pa.array(keys.view(np.int64))], ["h", "key"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t, i, words in zip(*(batch.column(c).to_pylist() for c in ("h", "t", "i", "words"))):
                doc, item = word_hashes(words_of(t)).view(np.int64), np.array(words, np.int64)
                near = np.flatnonzero(np.isin(doc, item))
                # A stretch that follows the item begins with one of its words, or one before it.
                starts = np.unique(np.concatenate([near, np.maximum(near - 1, 0)]))
                if follows(doc, starts[starts + STRETCH <= len(doc)], item):
                    out.append((h, i))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["h", "i"])

    known = cut_lineage(items.mapInArrow(item_words, "i bigint, words array<bigint>"))
    wanted = docs.sparkSession.sparkContext.broadcast(_pair_filter(known))
    windows = docs.mapInArrow(text_windows, "h string, key bigint")
    met = cut_lineage(windows.join(known.mapInArrow(item_windows, "key bigint, i bigint"), "key").select("h", "i").distinct())
    texts = docs.join(met.select("h").distinct(), "h", "left_semi")
    return met.join(texts, "h").join(known, "i").select("h", "t", "i", "words").mapInArrow(checked, "h string, i bigint").distinct()


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``key, item_key``, distinct: the documents that hold a stretch of an item.

    Items of up to ``INDEX_WORDS`` words in all, which is counted first, go to the tasks as an index, and whole document texts are searched
    where they are read; only results are shuffled. The windows of more items are joined (``_search_joined``); walks, steps and the exact
    check are the same. Null, empty and short texts hold nothing; a null key comes out as null; repeated rows give one result.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    asked = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    if (asked.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0) > INDEX_WORDS:
        hashed = slim.where("t is not null").withColumn("h", F.sha2("t", 256))
        once = hashed.groupBy("h").agg(F.first("t").alias("t"))
        found = cut_lineage(_search_joined(once, asked)).join(hashed.select("h", "k"), "h")
        return found.select(F.col("k").alias(key), F.col("i").cast(item_kind).alias(item_key)).distinct()
    index = docs.sparkSession.sparkContext.broadcast(build_index([(r["i"], r["t"]) for r in asked.collect()]))  # counted above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                keys = part.column(0)
                found = leaks_of(part.column(1).to_pylist(), index.value)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([d for d, _ in found], pa.int64())), pa.array([j for _, j in found], pa.int64())], ["k", "i"])

    return slim.mapInArrow(run, f"k {kind}, i bigint").distinct().select(F.col("k").alias(key), F.col("i").cast(item_kind).alias(item_key))
