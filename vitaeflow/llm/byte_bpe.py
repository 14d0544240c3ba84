"""Encoding a corpus with a public byte-level BPE vocabulary: batched numpy merge rounds.

The pieces of a batch's texts are looked up in a store of known pieces. Those that are new are merged together: their
symbols lie in one flat array, and each round finds every piece's pair of lowest rank by binary search over
the sorted pair keys and merges it, until no piece has a known pair.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.operators.dedup import one_per_key

#: The pattern that splits text before the merges; public together with the vocabulary. White space is named by its property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces a task keeps encoded; beyond that it starts afresh. Bounds memory only.
STORE_SIZE = 300_000
_SHIFT, _NONE = 17, np.int64(1 << 40)


@dataclass
class Merges:
    """``bytes_to_id[256]``; sorted ``keys`` (left id << 17 | right id) and the ids they merge to."""

    bytes_to_id: np.ndarray
    keys: np.ndarray
    ids: np.ndarray


def load_merges(path: str) -> Merges:
    """Out of a rank file (base64 token, rank): a token's pair is what the merges of lower rank leave of it."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    single = np.array([rank[bytes([i])] for i in range(256)], np.int64)
    keys, ids = [], []
    for token, r in rank.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((rank.get(parts[i] + parts[i + 1], r), i) for i in range(len(parts) - 1))
            if low >= r:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            keys.append(rank[parts[0]] << _SHIFT | rank[parts[1]])
            ids.append(r)
    order = np.argsort(keys)
    return Merges(single, np.array(keys, np.int64)[order], np.array(ids, np.int64)[order])


def merge_pieces(pieces: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, lengths)``: the ids of all pieces one after the other, and how many each has."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = m.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    done_sym, done_owner = [], []
    while len(sym):
        same = owner[:-1] == owner[1:]
        key = (sym[:-1] << _SHIFT) | sym[1:]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        rank = np.full(len(sym), _NONE)
        rank[:-1] = np.where(same & (m.keys[at] == key), m.ids[at], _NONE)
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        live = lowest < _NONE
        if not live.all():
            done_sym.append(sym[~live])
            done_owner.append(owner[~live])
            sym, owner, rank, lowest = sym[live], owner[live], rank[live], lowest[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == lowest)
        # In a run of overlapping hits every second one counts, from its start.
        fresh = np.concatenate(([True], np.diff(hit) != 1))
        run_start = np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(hit))))
        hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
        sym[hit] = rank[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, owner = sym[keep], owner[keep]
    sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int64)
    owner = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return sym[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))


class Encoder:
    """Texts to ids, with a store of pieces met before."""

    def __init__(self, merges: Merges) -> None:
        import regex

        self.find, self.merges = regex.compile(PATTERN).findall, merges
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of all texts; empty and null ones have no ids."""
        if len(self.code) > STORE_SIZE:
            self._reset()
        code, known = self.code, len(self.code)
        counts, codes = np.zeros(len(texts) + 1, np.int64), []
        for i, text in enumerate(texts):
            pieces = self.find(text) if text else ()
            codes += [code.setdefault(p, len(code)) for p in pieces]
            counts[i + 1] = len(pieces)
        if len(code) > known:
            new = [p.encode() for p in list(code)[known:]]
            ids, lengths = merge_pieces(new, self.merges)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(lengths) - lengths))
            self.length, self.flat = np.concatenate((self.length, lengths)), np.concatenate((self.flat, ids))
        at = np.array(codes, np.int64)
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[np.cumsum(counts)]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key, ids array<int>``, each key once; empty and null texts give an empty list.

    ``vocabulary`` is the path of a rank file on the driver; its merges (bounded by the vocabulary) are broadcast. Whole texts
    are encoded where they are read, after repeated keys are dropped there; nothing but keys is shuffled. A null
    key counts as one key. Texts of any length work; other columns are ignored.
    """
    merges = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    once = one_per_key(df.select(F.col(key), F.col(text)), key)
    return once.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The place of a public vocabulary file: in ``folder``, else in ``VITAEFLOW_TOKENIZERS``, else in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("VITAEFLOW_TOKENIZERS", "/opt/tokenizers"), name)
