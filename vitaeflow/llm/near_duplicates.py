"""Near-duplicate texts by the words they share: one-permutation hashing, banded buckets, star-shaped edges.

Similarity of two texts: shared word occurrences divided by the occurrences in either, a Jaccard similarity
of the sets of (word, how many-th occurrence). Texts with the same words are one class and are compared once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.operators.joins import pairs_in_blocks
from vitaeflow.sources.scratch import cut_lineage

LEAST_WORDS, SIMILARITY = 20, 0.75
#: Bands and rows of the signature: a pair at 0.8 meets in some band with probability 0.997, one at 0.75 with 0.966.
BANDS, ROWS = 32, 8
#: Bits of the sketch that sorts out most candidates, and the smallest share of equal bits that passes:
#: for a pair at SIMILARITY more than four standard deviations below what is expected.
SKETCH_BITS, SKETCH_SHARE = 256, 0.775
#: Texts whose signatures are computed together; bounds memory only.
TEXTS_AT_ONCE = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def elements(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of (word, occurrence): lower-cased runs of letters and digits."""
    h = xxhash.xxh3_64_intdigest
    out = [h(w if n == 0 else f"{w} {n}") for w, c in Counter(_WORD.findall(text.lower())).items() for n in range(c)]
    return np.sort(np.array(out, np.uint64))


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def one_permutation(e: np.ndarray, row: np.ndarray, n: int, bins: int, seed: int = 1) -> np.ndarray:
    """For each of ``n`` texts the smallest hash in each bin of one permutation; ``e`` holds all their elements, ``row`` their texts.

    Optimal densification fills an empty bin from a bin drawn by a hash of (bin, attempt), the same for all texts, until a
    filled one is met. All texts of a batch are handled at once in flat arrays.
    """
    h = _scramble(e, seed)
    at = (h >> np.uint64(32)) % np.uint64(bins)
    place = row * bins + at.astype(np.int64)
    value = h & np.uint64(0xFFFFFFFF) | (at << np.uint64(32))
    order = np.lexsort((value, place))
    place, value = place[order], value[order]
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    out[place[first]] = value[first]
    filled = np.zeros(n * bins, bool)
    filled[place[first]] = True
    some = filled.reshape(n, bins).any(axis=1)
    empty, attempt = np.flatnonzero(~filled & np.repeat(some, bins)), 1
    while len(empty):
        own, base = (empty % bins).astype(np.uint64), empty // bins * bins
        source = base + (_scramble(own + np.uint64(attempt << 32), seed + 7) % np.uint64(bins)).astype(np.int64)
        ok = filled[source]
        out[empty[ok]] = out[source[ok]]
        empty, attempt = empty[~ok], attempt + 1
    return out.reshape(n, bins)


def sketches(e: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """``SKETCH_BITS`` one-bit minima of each text in signed 64-bit words."""
    bits = (_scramble(one_permutation(e, row, n, SKETCH_BITS, 3), 11) >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def bands(e: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """One signed 64-bit hash of each band's rows for each text."""
    s = one_permutation(e, row, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
    key = np.repeat(_scramble(np.arange(BANDS, dtype=np.uint64), 5)[None, :], n, axis=0)
    for r in range(ROWS):
        key = _scramble(key ^ s[:, :, r], 13 + r)
    return key.view(np.int64)


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _long_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if i is not None and text is not None and len(e := elements(text)) >= LEAST_WORDS:
            yield i, e


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, TEXTS_AT_ONCE) for i in range(0, batch.num_rows, TEXTS_AT_ONCE)):
            rows = list(_long_texts(part))
            n = len(rows)
            e = np.concatenate([x for _, x in rows]) if n else np.empty(0, np.uint64)
            row = np.repeat(np.arange(n), [len(x) for _, x in rows])
            sk, keys = sketches(e, row, n), bands(e, row, n)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for _, x in rows], pa.string()), *(pa.array(np.ascontiguousarray(sk[:, c])) for c in range(len(_SKETCH))), flat],
                ["id", "class", *_SKETCH, "bands"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_long_texts(batch))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([e.view(np.int64) for _, e in rows], pa.list_(pa.int64()))], ["rep", "e"])


def _pairs(a: F.Column, b: F.Column) -> F.Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The candidate pairs whose sketches agree in enough bits."""
    side = lambda x: sketches.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _SKETCH])
    same = SKETCH_BITS - sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(same >= SKETCH_SHARE * SKETCH_BITS).select("a", "b")


def _exact(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``a, b, similarity`` of the pairs at or above ``SIMILARITY``, by all words."""
    el = lambda x: words.select(F.col("rep").alias(x), F.col("e").alias("e" + x))
    shared = F.size(F.array_intersect("ea", "eb"))
    scored = pairs.join(el("a"), "a").join(el("b"), "b").select("a", "b", (shared / (F.size("ea") + F.size("eb") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= SIMILARITY)


def near_duplicates(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``members(id, rep)`` and ``links(a, b, similarity)`` between class representatives.

    Texts with fewer than ``LEAST_WORDS`` words, null texts and null keys belong to no class. ``rep`` is the
    smallest id among texts with the same words. Every bucket of every band links its members to one of
    them only, which differs from band to band, so a bucket of n members gives n - 1 edges;
    links that stars leave out are found among the partners of a linked text.

    Texts leave the scan as signatures; whole texts are shuffled once, to the ids of likely pairs. Keys are integers.
    """
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    prints = cut_lineage(slim.mapInArrow(_fingerprints, "id bigint, class string, " + ", ".join(f"{c} bigint" for c in _SKETCH) + ", bands array<bigint>"))
    members = prints.groupBy("id").agg(F.min("class").alias("class"))  # a key counts once
    smallest = members.groupBy("class").agg(F.min("id").alias("rep"))
    members = members.join(smallest, "class").select("id", "rep")
    chosen = prints.join(smallest.select(F.col("rep").alias("id"), "class"), ["id", "class"], "left_semi")
    # A bucket's order is the id turned by the bucket's bits: its smallest value gives the centre back. Repeated rows change nothing.
    turned = lambda c: F.col(c).bitwiseXOR(F.xxhash64("bucket"))
    rows = chosen.select(F.col("id").alias("rep"), F.explode("bands").alias("bucket")).withColumn("order", turned("rep"))
    centres = rows.groupBy("bucket").agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low < high").select("bucket", turned("low").alias("centre"))
    stars = rows.join(centres, "bucket").where("rep <> centre").select(_pairs(F.col("rep"), F.col("centre")).alias("p")).distinct().select("p.*")
    sketches = chosen.groupBy(F.col("id").alias("rep")).agg(*[F.min(c).alias(c) for c in _SKETCH])
    likely = cut_lineage(_likely(stars, sketches))
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    words = slim.join(wanted, "id", "left_semi").mapInArrow(_elements, "rep bigint, e array<bigint>").join(chosen.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi")
    words = cut_lineage(words.groupBy("rep").agg(F.first("e").alias("e")))
    links = cut_lineage(_exact(likely, words))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Partners of a linked text, in blocks, so that a text with very many links fills no task.
    around = pairs_in_blocks(both, "a", "b")
    more = around.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
    links = links.unionByName(_exact(more, words))
    return members.select(F.col("id").cast(kind).alias("id"), F.col("rep").cast(kind).alias("rep")), links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of keys: of linked classes, and within a class, in blocks. Its size is that of the answer."""
    m = members.select(F.col("id"), F.col("rep"))
    left, right = m.select(F.col("rep").alias("ra"), F.col("id").alias("ia")), m.select(F.col("rep").alias("rb"), F.col("id").alias("ib"))
    across = links.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(left, "ra").join(right, "rb").select(_pairs(F.col("ia"), F.col("ib")).alias("p"))
    within = pairs_in_blocks(m, "rep", "id").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.select("p.*").unionByName(within)
