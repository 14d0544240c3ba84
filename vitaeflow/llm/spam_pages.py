"""Pages of repeated keywords, links or tags: bagged trees on content and link features, smoothed by host.

Features are taken from whole texts. Function words, which hold sentences together, are known for four languages and learned from the
corpus for others; where a page's language is none of these, nothing is concluded from their absence. Rules that only speak where they are sure give weak labels; bagged
decision trees learn from a bounded sample of these and score every page; the score then is drawn towards
the spam rate of the page's host.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.operators.joins import join_lookup
from vitaeflow.sources.scratch import cut_lineage

#: Weakly labelled pages the trees are fitted on, half of each label, drawn by a hash of the key.
SAMPLE = 20_000
TREES, DEPTH = 40, 6
#: Pages of its own that a host's rate counts against, and how far the rate moves a page's log-odds.
HOST_PRIOR, HOST_WEIGHT = 50.0, 0.15
#: Words of a text below which nothing can be said.
LEAST_WORDS = 8

#: A page is of a listed language from this share of function words on. Words of such pages that occur in two pages, and in one
#: of so many, are common words of the corpus; a page with a smaller share of them than the other figure is in another language.
COVERED, COMMON_PAGES, COMMON_SHARE = 0.15, 20_000, 0.3
#: Words of pages in other languages that occur in this part of the pages the script's most frequent one occurs in, and in so many pages, are function words.
FUNCTION_SHARE, FUNCTION_PAGES = 0.2, 10
#: What stands for the share of function words where a page's language isn't known.
USUAL_SHARE = 0.3

FEATURES = ("stuffed", "function_words", "repeated_pairs", "top_phrase", "links", "packed", "tags", "signs", "stops", "repeated_lines", "distinct")
# Words that hold sentences together, in English, German, Spanish and French.
_FUNCTION = frozenset(
    """the a an of to in and for with on at is was are were it its that this these those by from as you i we he she they my your our his her their be been
    have has had do does did not but or if so than then when where which who whom whose what how why will would can could should may might must there here
    into about over after before under between because while during without within through no nor very more most some any all each every other such only own
    me him them us up out off again once both few same too just also still
    der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde hat haben hatte ich du er sie es wir ihr mit für
    von vom zu zum zur im am auf aus bei nach als auch wie so dass wenn weil um über unter vor durch ohne sich mein meine ihre unser kein keine noch nur
    el la los las un una unos unas y o u pero no es son era fue ser ha han he yo tú ella ellos nosotros con por para de del al en que se su sus lo le les mi
    como más muy cuando donde porque sin sobre entre hasta desde también ya
    le les un une des du et ou mais ne pas est sont était a ont avait je tu il elle nous vous ils elles avec pour par sur dans au aux que qui se sa son ses ce cette
    ces mon ma mes votre notre leur plus très comme où sans sous entre depuis aussi d l qu n s c j m""".split()
)
_LINK = re.compile(r"\[([^\]\n]*)\]\((?:https?://|www\.)?[^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|net|org|example|test|invalid)/\S*", re.I)
_TAG = re.compile(r"(?<!\w)#[^\W_]\w+")
_HTML = re.compile(r"<[^<>\n]{1,200}>")
_WORD = re.compile(r"[^\W\d_]+")
_ANCHOR = re.compile(r"<a\s[^<>]*href[^<>]*>(.*?)</a\s*>", re.I | re.S)
_END = re.compile(r"[.!?]+(?=[\s\"')\]]|$)|[。！？؟।]")
_SEGMENT = re.compile(r"[\r\n  ]+|(?<=[.!?。！？؟।])[ \t]*(?<![.!?])|(?<=[.!?])[ \t]+")


def _phrases(words: list[str], function: frozenset[str]) -> Counter:
    """Pairs of words with at least one that isn't a function word."""
    return Counter(p for p in zip(words, words[1:]) if p[0] not in function or p[1] not in function)


def _readable(text: str) -> tuple[str, int]:
    """The text without markup, with links of markup as written links, and the number of the latter."""
    n = 0
    if "<" in text:
        text, n = _ANCHOR.subn(lambda m: f"[{_HTML.sub(' ', m[1])}](x)", text)
        text = _HTML.sub(" ", text)
    return (html.unescape(text) if "&" in text else text), n


def script_of(text: str) -> str:
    """Latin, or the name of the block that the first other letter is in, by 256 signs; enough to tell scripts apart."""
    if text.isascii():
        return "latin"
    counts = Counter("latin" if c < "\u0250" else f"{ord(c) >> 8:x}" for c in text if c.isalpha())
    return counts.most_common(1)[0][0] if counts else "latin"


def _sentences(text: str, n: int) -> bool:
    """Whether a text of ``n`` words has the shape of sentences in whatever language: ends of sentences at the distance of sentences, hardly a tag."""
    ends = len(_END.findall(text))
    return ends >= 2 and 4 <= n / ends <= 40 and text.count("#") * 8 < n


def features_of(text: str | None, function: frozenset[str] = _FUNCTION, common: frozenset[str] | None = None) -> list[float] | None:
    """``FEATURES`` of a text; None for null texts and such with fewer than ``LEAST_WORDS`` words and links.

    ``function``: known function words; ``common``: common words of the corpus (None: not known, every page counts as in a listed language).
    """
    if not text:
        return None
    text, anchors = _readable(text)
    words = _WORD.findall(text.lower())
    n = len(words)
    if n < LEAST_WORDS and anchors < LEAST_WORDS // 2:
        return None
    n = max(n, 1)
    single = Counter(words)
    share = sum(c for w, c in single.items() if w in function) / n
    foreign = common is not None and share < COVERED and _sentences(text, n) and sum(w in common for w in single) < COMMON_SHARE * len(single)
    pairs = _phrases(words, function)
    # The words of the phrase, or the word, that makes up a good part of the whole text.
    keyword: set[str] = set()
    if pairs:
        top, count = pairs.most_common(1)[0]
        if 2 * count / n >= 0.15:
            keyword = {w for p, c in pairs.items() if c >= 0.6 * count and set(p) & set(top) for w in p}
    keyword |= {w for w, c in single.items() if c >= 5 and (c / n >= 0.12 and w not in function or c / n >= 0.4)}
    stuffed = total = links = tags = stops = 0
    lines: Counter = Counter()
    linked, tagged = "/" in text or "www." in text or "](" in text, "#" in text
    for segment in _SEGMENT.split(text):
        own = _WORD.findall(segment.lower())
        k = len(own)
        if not k:
            continue
        said, link_words, tag_words = own, 0, 0
        if linked and ("/" in segment or "www." in segment or "](" in segment):
            plain = _LINK.sub(" ", segment)
            said = _WORD.findall(plain.lower())
            link_words = k - len(said)
        if tagged and "#" in segment:
            tag_words = sum(len(_WORD.findall(t)) for t in _TAG.findall(plain if link_words else segment))
        glue = sum(w in function for w in said)
        key = sum(w in keyword for w in own) if keyword else 0
        total, links, tags = total + k, links + link_words, tags + tag_words
        stops += segment.rstrip(" \t\"')]").endswith((".", "!", "?", "。", "！", "？", "؟", "।"))
        lines[segment.strip().lower()] += k
        sentence = glue >= 3 and glue >= 0.12 * len(said)
        if (link_words + tag_words > k / 2 and not sentence) or (glue < 0.1 * k and not foreign) or key > 0.35 * k:
            stuffed += k
    heads = Counter(line.split(" ")[0] for line in lines)
    repeated = sum(k for line, k in lines.items() if heads[line.split(" ")[0]] > 3)
    raw = text.encode()
    return [
        stuffed / max(total, 1), USUAL_SHARE if foreign else share, 1 - len(set(zip(words, words[1:]))) / max(n - 1, 1),
        min(1.0, 2 * max(pairs.values(), default=0) / n), links / n, len(zlib.compress(raw, 1)) / max(len(raw), 1), tags / n,
        sum(map(text.count, ",|;/>#•·")) / n, stops / n, repeated / max(total, 1), len(single) / n,
    ]


def learn_words(df: DataFrame, text: str) -> tuple[frozenset[str], frozenset[str]]:
    """(function words, common words) of a corpus: the listed function words and those learned, and the words of pages in listed languages.

    Pages are counted per word within a batch before the shuffle. The driver receives words by their share of pages: of common words there are
    at most ``COMMON_PAGES`` times the words of a page, of function words few, since each occurs in a good part of a script's pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                words = _WORD.findall(_readable(t)[0].lower())
                own = set(words)
                if not words:
                    continue
                if sum(w in _FUNCTION for w in words) >= COVERED * len(words):
                    counts.update(("", w) for w in own)
                    counts["", ""] += 1
                elif len(own) > len(words) / 3 and _sentences(t, len(words)):  # of lists and pages that repeat themselves nothing is learned
                    script = script_of(t)
                    counts.update((script, w) for w in own)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["script", "word", "n"])

    counts = cut_lineage(df.select(text).mapInArrow(run, "script string, word string, n bigint").groupBy("script", "word").agg(F.sum("n").alias("n")))
    pages = (counts.where("script = '' and word = ''").agg(F.sum("n")).first()[0] or 0)
    common = counts.where((F.col("script") == "") & (F.col("word") != "") & (F.col("n") >= max(2, pages / COMMON_PAGES))).select("word")
    other = counts.where("script <> ''").join(counts.where("script = '' and n > 1").select("word"), "word", "left_anti")
    most = other.groupBy("script").agg(F.max("n").alias("most"))
    learned = other.join(F.broadcast(most), "script").where((F.col("n") >= FUNCTION_PAGES) & (F.col("n") >= FUNCTION_SHARE * F.col("most"))).select("word").distinct()  # one row a script
    return _FUNCTION | {r["word"] for r in learned.collect()}, frozenset(r["word"] for r in common.collect())


def page_features(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``key, host, f array<double>`` of every row; ``f`` is null where nothing can be said. Texts are not shuffled."""
    words = df.sparkSession.sparkContext.broadcast(learn_words(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, common = words.value
        for batch in batches:
            rows = [features_of(t, function, common) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["key", "host", "f"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(host).cast("string"), F.col(text)).mapInArrow(run, f"key {kind}, host string, f array<double>")


def weak_label(f: Column) -> Column:
    """1 where stuffing is beyond doubt, 0 where prose is, else null."""
    at = {name: f[i] for i, name in enumerate(FEATURES)}
    sure = (at["stuffed"] > 0.7) & ((at["function_words"] < 0.08) | (at["links"] > 0.5) | (at["tags"] > 0.5) | (at["top_phrase"] > 0.3) | (at["repeated_pairs"] > 0.5))
    prose = (at["stuffed"] < 0.35) & (at["function_words"] > 0.14) & (at["top_phrase"] < 0.2) & (at["tags"] < 0.1)
    return F.when(sure, 1.0).when(prose, 0.0)


def score_pages(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``key, host, score, smoothed`` for every row, of which texts too short to say anything score 0.

    A null host is a host of its own. Without labels of both kinds the rules' label is the score. The host rates are an
    aggregate with a row per host; pages of hot hosts get theirs where they are, without a shuffle.
    """
    pages = cut_lineage(page_features(df, key, text, host).withColumn("host", F.coalesce("host", F.lit(""))))
    known = pages.where("f is not null")
    labelled = known.select("key", "f", weak_label(F.col("f")).alias("label")).where("label is not null")
    half = [labelled.where(F.col("label") == v).orderBy(F.xxhash64("key", F.lit(29))).limit(SAMPLE // 2) for v in (0.0, 1.0)]
    sample = cut_lineage(half[0].unionByName(half[1]).select("label", array_to_vector("f").alias("features")))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) == 2:
        trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=0.6, minInstancesPerNode=3, seed=11)
        model = trees.fit(sample)
        scored = model.transform(known.withColumn("features", array_to_vector("f"))).select("key", "host", vector_to_array("probability")[1].alias("score"))
    else:
        scored = known.select("key", "host", F.coalesce(weak_label(F.col("f")), F.lit(0.0)).alias("score"))
    scored = cut_lineage(scored.unionByName(pages.where("f is null").select("key", "host", F.lit(0.0).alias("score"))))
    hosts = scored.groupBy("host").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    mean = scored.agg(F.avg("score")).first()[0] or 0.0
    rates = cut_lineage(hosts.select("host", "n", ((F.col("s") + HOST_PRIOR * mean) / (F.col("n") + HOST_PRIOR)).alias("rate")))
    bound = lambda c: F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    logit = lambda c: F.log(bound(c) / (1 - bound(c)))
    moved = logit(F.col("score")) + HOST_WEIGHT * (logit(F.col("rate")) - logit(F.lit(mean)))
    smoothed = F.when(F.col("score") > 0, 1 / (1 + F.exp(-moved))).otherwise(0.0)
    return join_lookup(scored, rates, ["host"], "n").select("key", "host", "score", smoothed.alias("smoothed")).withColumnRenamed("key", key)
