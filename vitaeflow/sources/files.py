"""Resume files as tables: reading by format, gates with reasons, folders and CSV files."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions and size limit.
EXTENSIONS = (".pdf", ".docx", ".doc", ".txt")
MAX_BYTES = 10 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``filename, path, length, content`` of a folder; ``content`` isn't read where a query doesn't select it.

    The scan passes over files without bytes; their names come from the file system's listing.
    """
    empty = spark.createDataFrame([(p, 0, bytearray()) for p in _empty_files(spark, folder, pattern)], "path string, length bigint, content binary")
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    f = f.select("path", "length", "content").unionByName(empty)
    return f.select(F.substring_index("path", "/", -1).alias("filename"), "path", "length", "content")


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    jvm, found = spark.sparkContext._jvm, []
    root = jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0 and fnmatch.fnmatch(f.getPath().getName(), pattern):
            found.append(f.getPath().toString())
    return found


def gate(filename: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file isn't read, else null."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))
    return (
        F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("unsupported file type: "), ext)).when(length == 0, "file is empty")
        .when(length > max_bytes, F.concat(F.lit("file exceeds "), F.lit(max_bytes // 1048576), F.lit(" MB")))
    )


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; no byte order mark; no empty lines."""
    t = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    t = F.regexp_replace(t, "^﻿", "")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    return F.array_join(lines, "\n")


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with `` | `` between cells; equal neighbouring cells once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        cells: list[str] = []
        for c in row.findall(f"{_W}tc"):
            t = " ".join(filter(None, (text(p) for p in c.iter(f"{_W}p"))))
            if t and (not cells or cells[-1] != t):
                cells.append(t)
        out.append(" | ".join(cells))
    return "\n".join(filter(None, out))


def doc_text(data: bytes) -> str:
    """Readable runs of an old binary document: UTF-16 ones of three letters or more, then plain ones not yet met."""
    wide = [m.group().decode("utf-16-le") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff]\x00){3,}", data)]
    plain = [m.group().decode("latin-1") for m in re.finditer(rb"[\x20-\x7e]{3,}", data)]
    seen = "\n".join(wide)
    return "\n".join([*wide, *(p for p in plain if p not in seen)])


def _extract(extractors: dict):
    readers = {".docx": docx_text, ".doc": doc_text} | extractors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for name, data, why in zip(*(batch.column(c).to_pylist() for c in ("filename", "content", "error"))):
                text, error = None, why
                read = readers.get("." + (name or "").lower().rpartition(".")[2])
                if why is None and read is None:
                    error = "no reader for this format"
                elif why is None:
                    try:
                        text = read(data).strip() or None
                        error = None if text else "no text found"
                    except Exception as e:  # noqa: BLE001 - a broken file becomes a row with its reason
                        error = f"unreadable: {type(e).__name__}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["filename", "hash", "text", "error"])

    return run


def extract_texts(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """``filename, hash, text, status, error``: analyzed, failed or duplicate, one row per file.

    Plain text stays in the JVM; other formats go through Arrow batches. ``extractors`` adds readers by extension (``.pdf`` has none of
    its own). A file whose bytes equal those of a file with a smaller name is a duplicate, readable or not; only hashes are shuffled for that.
    """
    f = files.withColumn("error", gate(F.col("filename"), F.col("length"))).withColumn("hash", F.sha2("content", 256))
    is_text = F.lower("filename").endswith(".txt")
    plain = f.where(is_text).select("filename", "hash", F.when(F.col("error").isNull(), F.nullif(decode_text(F.col("content")), F.lit(""))).alias("text"), "error")
    plain = plain.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), "no text found")))
    rest = f.where(~is_text).select("filename", "hash", "content", "error").mapInArrow(_extract(extractors or {}), "filename string, hash string, text string, error string")
    both = plain.unionByName(rest)
    first = both.where(~F.coalesce(F.col("error").rlike("^unsupported|^file is empty|^file exceeds"), F.lit(False))).groupBy("hash").agg(F.min("filename").alias("first"))
    j = both.join(first, "hash", "left")
    copy = F.col("first").isNotNull() & (F.col("filename") != F.col("first"))
    return j.select("filename", "hash", F.when(~copy, F.col("text")).alias("text"), F.when(copy, "duplicate").when(F.col("error").isNotNull(), "failed").otherwise("analyzed").alias("status"), F.when(copy, F.concat(F.lit("same as "), F.col("first"))).otherwise(F.col("error")).alias("error"))


def read_ratings(spark: SparkSession, path: str, raters: list[str], key: str = "pair_id") -> DataFrame:
    """Rating pairs of a CSV file: example rows left out, ratings outside 0-100 or not numbers as null, rows without any left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    num = lambda c: F.when(F.col(c).try_cast("double").between(0, 100), F.col(c).try_cast("double")).alias(c)
    rows = raw.where(~F.col(key).startswith("EXAMPLE")).select(*[c for c in raw.columns if c not in raters], *map(num, raters))
    return rows.where(F.coalesce(*raters).isNotNull())


def read_corpus(spark: SparkSession, path: str, label: str, text: str) -> DataFrame:
    """``label, text`` of a CSV file with quoted line breaks; a missing column is an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if missing := {label, text} - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return raw.select(F.col(label).alias("label"), F.col(text).alias("text")).where(F.trim("text") != "")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``filename, text`` of whole text files."""
    t = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return t.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
