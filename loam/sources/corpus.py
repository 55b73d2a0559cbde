"""A folder of documents as chunk rows, and other file sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import glob_regex
from loam.sources import chunkers, office

#: File types that are read, by kind.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff")
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp")
LEGACY = ("doc", "xls", "ppt", "pdf")
MARKDOWN, TABLES, MARKUP = ("md", "markdown"), ("csv", "tsv"), ("html", "htm")
TEXTS = tuple("txt log rst json yaml yml toml xml ini cfg conf rs py js ts tsx jsx java kt c h cpp cc hpp cs go rb php sh bash ps1 sql r lua swift".split())
EVERY = (*IMAGES, *OFFICE, *LEGACY, *MARKDOWN, *TABLES, *MARKUP, *TEXTS)

#: Readers of further formats: a function of bytes and file type to ``(location, text)`` pairs, by type.
EXTRACTORS: dict[str, Callable[[bytes, str], list[tuple[str, str]]]] = {}


def extract(path: str, data: bytes | None) -> list[tuple[str, str]]:
    """Chunks of one file. Formats without a reader here (and without one in ``EXTRACTORS``) stand for their name."""
    name = path.replace("\\", "/").split("/")[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else "txt"
    if kind in IMAGES:
        return chunkers.image_name(path)
    data = bytes(data or b"")
    if kind in EXTRACTORS:
        return EXTRACTORS[kind](data, kind)
    if kind in OFFICE:
        return office.office(data, kind)
    if kind in LEGACY:
        return [("(no-text)", name.rsplit(".", 1)[0])]
    text = chunkers.decode_text(data)
    if text is None:
        return []
    if kind in MARKDOWN:
        return chunkers.markdown(text)
    if kind in TABLES:
        return chunkers.delimited(text)
    return chunkers.html(text) if kind in MARKUP else chunkers.windows(text)


def relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    return F.regexp_replace(F.substring(plain, len(root.rstrip("/")) + 1, 1 << 30), "^/+", "")


def list_files(spark: SparkSession, root: str, glob: str | None = None, types: tuple[str, ...] = EVERY, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``doc_path, file_sig``: files of the wanted types below a folder that fit the glob and none of the ignored globs.
    Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    out = files.select(
        relative(F.col("path"), root).alias("doc_path"),
        F.struct(F.unix_seconds(F.col("modificationTime").cast("timestamp")).alias("mtime_secs"), F.col("length").alias("size")).alias("file_sig"),
    )
    out = out.where(F.lower(F.regexp_extract("doc_path", r"\.([^./]+)$", 1)).isin(*types))
    for pattern in ignored:
        out = out.where(~F.col("doc_path").rlike(glob_regex(pattern)))
    return out if glob is None else out.where(F.col("doc_path").rlike(glob_regex(glob)))


def read_corpus(spark: SparkSession, root: str, glob: str | None = None, types: tuple[str, ...] = EVERY) -> DataFrame:
    """``doc_path, location, ord, file_type, text`` of every file below a folder, chunks numbered from 1 within a file.
    A file that fails to read has no chunks and stops nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(relative(F.col("path"), root).alias("doc_path"), "content")
    rows = rows.where(F.lower(F.regexp_extract("doc_path", r"\.([^./]+)$", 1)).isin(*types))
    if glob is not None:
        rows = rows.where(F.col("doc_path").rlike(glob_regex(glob)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["doc_path"], pdf["content"]):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    chunks = extract(path, data)
                except Exception:  # one unreadable file must not stop a corpus  # noqa: BLE001
                    chunks = []
                out.extend((path, where, k, kind, text) for k, (where, text) in enumerate(chunks, 1))
            yield pd.DataFrame(out, columns=["doc_path", "location", "ord", "file_type", "text"])

    return rows.mapInPandas(run, "doc_path string, location string, ord bigint, file_type string, text string")


def window_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, location, text``: the line windows of a text column. Null and blank texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, where, part) for k, t in zip(pdf[key], pdf[text]) if t for i, (where, part) in enumerate(chunkers.windows(t), 1)]
            yield pd.DataFrame(out, columns=[key, "ord", "location", "text"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, ord bigint, location string, text string")


QUESTION = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title: string, sentences: array<string>>>, supporting_titles array<string>"


def read_hotpot(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``_id, question, answer, context, supporting_facts`` as questions."""
    raw = spark.read.schema("_id string, question string, answer string, context array<array<variant>>, supporting_facts array<array<variant>>").option("multiLine", "true").json(path)
    string = lambda x: F.try_variant_get(x, "$", "string")
    paragraphs = F.transform("context", lambda p: F.struct(string(p[0]).alias("title"), F.try_variant_get(p[1], "$", "array<string>").alias("sentences")))
    titles = F.array_distinct(F.transform("supporting_facts", lambda f: string(f[0])))
    return raw.select(F.col("_id").alias("id"), "question", "answer", F.array().cast("array<string>").alias("answer_aliases"), paragraphs.alias("paragraphs"), titles.alias("supporting_titles"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions as JSON lines; malformed lines are dropped."""
    return spark.read.schema(QUESTION).option("mode", "DROPMALFORMED").json(path)


def read_trace(spark: SparkSession, path: str, first_ms: int | None = None, last_ms: int | None = None) -> DataFrame:
    """Tool-call entries ``ts_ms, tool, args, result`` within a time window, in order; malformed lines are dropped."""
    rows = spark.read.schema("ts_ms bigint, tool string, args string, result string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("ts_ms").isNotNull() & F.col("tool").isNotNull()).drop("_bad")
    if first_ms is not None:
        rows = rows.where(F.col("ts_ms") >= first_ms)
    if last_ms is not None:
        rows = rows.where(F.col("ts_ms") <= last_ms)
    return rows.orderBy("ts_ms")
