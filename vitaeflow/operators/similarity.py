"""Similarity of chunk sets within a pair, of vectors, and near-duplicate groups of short rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaeflow.functions.phrases import bound
from vitaeflow.sources.scratch import cut_lineage

# English words that say nothing about a topic.
STOP_WORDS = tuple("a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())


def terms(text: Column, pairs: bool = True) -> Column:
    """Lower-cased words of two letters or more without stop words, and pairs of neighbours."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9+#]+)"), 1), lambda x: ~x.isin(*STOP_WORDS))
    if not pairs:
        return w

    def with_pairs(words: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
        return F.when(F.size(words) > 1, F.concat(words, two)).otherwise(words)

    return bound(w, with_pairs)


def tfidf_weights(chunks: DataFrame, group: list[str], item: str, text: str, pairs: bool = True) -> DataFrame:
    """``*group, item, term, w``: unit vectors per item; idf is fitted within each group, tf is ``1 + ln``."""
    t = chunks.select(*group, item, F.explode(terms(F.col(text), pairs)).alias("term")).groupBy(*group, item, "term").agg(F.count("*").alias("c"))
    n = chunks.groupBy(*group).agg(F.countDistinct(item).alias("n"))
    df = t.groupBy(*group, "term").agg(F.count("*").alias("df"))
    w = t.join(df, [*group, "term"]).join(n, group) if group else t.join(df, "term").crossJoin(F.broadcast(n))  # one row
    w = w.withColumn("x", (1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(*group, item).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return w.join(norm, [*group, item]).select(*group, item, "term", (F.col("x") / F.col("norm")).alias("w"))


def best_matches(chunks: DataFrame, pair: str, side: str, item: str, text: str, left: str, right: str) -> DataFrame:
    """``pair, item, best, cosine``: for each chunk of the left side the closest one of the right side; 0 where no term is shared."""
    w = tfidf_weights(chunks.withColumn("__id", F.concat_ws(":", side, item)), [pair], "__id", text)
    own = lambda s, i, v: w.where(F.col("__id").startswith(f"{s}:")).select(pair, "term", F.substring_index("__id", ":", -1).cast("int").alias(i), F.col("w").alias(v))
    dot = own(left, item, "wl").join(own(right, "other", "wr"), [pair, "term"]).groupBy(pair, item, "other").agg(F.sum(F.col("wl") * F.col("wr")).alias("cosine"))
    top = dot.groupBy(pair, item).agg(F.max(F.struct(F.round("cosine", 9).alias("c"), (-F.col("other")).alias("o"))).alias("m"))
    return chunks.where(F.col(side) == left).select(pair, F.col(item).cast("int").alias(item)).distinct().join(top, [pair, item], "left").select(pair, item, (-F.col("m.o")).alias("best"), F.coalesce(F.col("m.c"), F.lit(0.0)).alias("cosine"))


def semantic_score(matches: DataFrame, pair: str) -> DataFrame:
    """The mean over left chunks of the clipped best cosine."""
    return matches.groupBy(pair).agg(F.round(F.avg(F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0))), 4).alias("score"))


def normalize_similarity(cosine: Column, low: float = 0.15, high: float = 0.65) -> Column:
    return F.lit(0.0) if high <= low else F.least(F.greatest((cosine - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


#: Queries whose vectors are sent to the tasks at once, and those multiplied with a batch of rows at once.
QUERY_BLOCK, QUERY_CHUNK = 50_000, 1024


def _unit_rows(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _first_of_each(q: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: by score, ties by key."""
    order = np.lexsort((key, -score, q))
    q, score, key = q[order], score[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[place < k], score[place < k], key[place < k]


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``key, neighbour, cosine, rank``: exact search of a stated query set against all rows, in blocks.

    ``QUERY_BLOCK`` queries at a time go to the tasks; each multiplies them with its batches of rows and keeps the k best of every query, which
    alone are shuffled. A query isn't its own neighbour; null keys and vectors are left out; a zero vector has cosine 0 with all.
    """
    kind = rows.schema[key].dataType.simpleString()
    filled = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    q, r, out = filled(queries), filled(rows), None
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        shared = rows.sparkSession.sparkContext.broadcast(([x["key"] for x in part], _unit_rows([x["v"] for x in part]) if part else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, units = shared.value
            names, best, kept = np.array(asked), {}, None
            for batch in batches:
                if not batch.num_rows or not len(asked):
                    continue
                kept = batch.schema.field(0).type
                own, m = np.array(batch.column(0).to_pylist()), _unit_rows(batch.column(1).to_pylist())
                for c in range(0, len(asked), QUERY_CHUNK):
                    score = np.round(units[c : c + QUERY_CHUNK] @ m.T, 6)
                    score[names[c : c + QUERY_CHUNK, None] == own[None, :]] = -np.inf
                    least = np.partition(score, -min(k, len(own)), axis=1)[:, -min(k, len(own))]
                    i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    new = (i, score[i, j], own[j])
                    best[c] = _first_of_each(*(map(np.concatenate, zip(best[c], new)) if c in best else new), k)
            for c, (i, score, found) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(names[c + i].tolist(), kept), pa.array(found.tolist(), kept), pa.array(score)], ["q", "neighbour", "cosine"])

        hits = r.mapInArrow(run, f"q {kind}, neighbour {kind}, cosine double")
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(key), "neighbour", "cosine", "rank")


def mean_vectors(df: DataFrame, owner: str, vector: str) -> DataFrame:
    """``owner, vector``: the mean of the owner's vectors, of length 1."""
    parts = df.select(owner, F.posexplode(vector).alias("i", "x")).groupBy(owner, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = parts.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("v"))
    return v.select(owner, F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("vector"))


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first_key, is_first``: rows of the same text against the smallest key. Texts are compared by SHA-256, which
    alone is shuffled; the smallest key is combined before the shuffle, so that a text with a third of all rows is a row per task."""
    h = df.where(F.col(text).isNotNull()).select(F.col(key), F.sha2(text, 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min(key).alias("first_key")), "h").select(key, "first_key", (F.col(key) == F.col("first_key")).alias("is_first"))


def connected_groups(nodes: DataFrame, edges: DataFrame, node: str = "id", rounds: int = 50) -> DataFrame:
    """``node, group``: the smallest node that can be reached. Each round takes the smallest label among neighbours and
    then the label of the label, which halves the way; stops where nothing changes, and raises where that isn't reached."""
    both = cut_lineage(edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select(F.col(node).alias("n"), F.col(node).alias("g")).distinct())
    for _ in range(rounds):
        near = both.join(labels.select(F.col("n").alias("b"), "g"), "b").groupBy(F.col("a").alias("n")).agg(F.min("g").alias("m"))
        step = labels.join(near, "n", "left").select("n", F.col("g").alias("old"), F.least("g", F.coalesce("m", "g")).alias("g"))
        jump = step.join(step.select(F.col("n").alias("g"), F.col("g").alias("gg")), "g", "left").select("n", "old", F.least("g", F.coalesce("gg", "g")).alias("g"))
        labels = cut_lineage(jump)
        if not labels.where("g <> old").limit(1).count():
            break
        labels = labels.select("n", "g")
    else:
        raise ValueError(f"The groups have not settled after {rounds} rounds.")
    return labels.select(F.col("n").alias(node), F.col("g").alias("group"))


def similar_rows(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``a, b, cosine``: pairs of short texts whose TF-IDF cosine (single words) is at least ``least``; exact.

    Equal texts are compared once, and linked to the smallest key only. Candidates share a term of the prefix: terms
    are sorted by rarity, and a pair at ``least`` shares one before the rest's length falls below it.
    """
    texts = exact_duplicates(df, key, text)
    one = df.join(texts.where("is_first").select(key), key, "left_semi").select(F.col(key).alias("k"), text)
    w = tfidf_weights(one, [], "k", text, pairs=False)
    df_of = w.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("k").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The most frequent terms come first here: as long as their squares sum to less than least ** 2 they can't reach it alone.
    ranked = w.join(df_of, "term").withColumn("tail", F.sum(F.col("w") ** 2).over(order))
    w = cut_lineage(ranked.select("k", "term", "w", (F.col("tail") >= least * least - 1e-9).alias("prefix")))
    p = w.where("prefix").select("term", "k")
    cand = p.select("term", F.col("k").alias("a")).join(p.select("term", F.col("k").alias("b")), "term").where("a < b").select("a", "b").distinct()
    va, vb = w.select(F.col("k").alias("a"), "term", F.col("w").alias("wa")), w.select(F.col("k").alias("b"), "term", F.col("w").alias("wb"))
    cos = cand.join(va, "a").join(vb, ["b", "term"]).groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine")).where(F.col("cosine") >= least)
    copies = texts.where(~F.col("is_first")).select(F.col("first_key").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("cosine"))
    return cos.unionByName(copies)
