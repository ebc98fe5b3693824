"""Document files: listing, text extraction, inventories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import ship_package
from textmatch.functions.text import base_name, base_stem, clean_text, extension
from textmatch.functions.text import fingerprint, preview

# Extensions listed in a folder, and extensions an extractor accepts.
LISTED = (".pdf", ".docx", ".doc")
ACCEPTED = (".pdf", ".docx", ".doc", ".docs")

# Bytes to the pages of a document.
Extractor = Callable[[bytes], list[str]]


def is_document(path: Column, extensions: tuple[str, ...] = LISTED) -> Column:
    """Whether the extension is supported, in either case."""
    return extension(path).isin(*extensions)


def list_files(
    spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True
) -> DataFrame:
    """``(path, modificationTime, length)`` of a folder's files; contents stay unread."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "modificationTime", "length")


def scan_folder(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] = LISTED
) -> DataFrame:
    """The documents of a folder with their contents."""
    # A glob in both cases keeps other files from being read at all.
    names = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{{{','.join(names)}}}")
        .load(folder)
    )
    return files.filter(is_document(F.col("path"), extensions))


def file_formats(files: DataFrame) -> DataFrame:
    """Per extension: number of files and total size in MB."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(
        F.count(F.lit(1)).alias("files"),
        (F.sum("length") / (1024.0 * 1024.0)).alias("size_mb"),
    )


def file_details(files: DataFrame) -> DataFrame:
    """Each file with its extension, size in MB and time of change."""
    return files.select(
        extension(F.col("path")).alias("ext"),
        "path",
        (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"),
        F.col("modificationTime").alias("modified"),
    )


def latest_artifact(
    spark: SparkSession, folder: str, pattern: str = "*", prefix: str = "tfidf_enhanced_"
) -> DataFrame:
    """One row ``(path, modified)``: the newest file matching ``pattern`` in the folder
    itself or in one of its ``prefix*`` folders; null when there is none."""
    root = re.escape(folder.rstrip("/").rsplit("/", 1)[-1])
    place = rf"/{root}/(?:{re.escape(prefix)}[^/]*/)?[^/]+$"
    found = list_files(spark, folder, pattern).filter(F.col("path").rlike(place))
    return found.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
        F.max("modificationTime").alias("modified"),
    )


def reject_unsupported(
    documents: DataFrame, extensions: tuple[str, ...] = ACCEPTED
) -> DataFrame:
    """Add ``error``: set for a file of a format no extractor takes, null otherwise."""
    ext = extension(F.col("path"))
    return documents.withColumn(
        "error",
        F.when(~ext.isin(*extensions), F.concat(F.lit("Unsupported file format: "), ext)),
    )


def extract_text(
    documents: DataFrame, primary: Extractor, fallback: Extractor | None = None
) -> DataFrame:
    """``(path, text, error)`` by running an extractor over ``(path, content, error)``.

    Pages are joined by a blank and line ends become blanks. A blank or failing result is
    tried again with the fallback. A document that fails keeps its row, with the reason.
    """
    ship_package(documents.sparkSession)

    def one(extractor: Extractor, content: bytes) -> str:
        return " ".join(extractor(content)).replace("\n", " ").strip()

    def text_of(content: bytes | None) -> tuple[str | None, str | None]:
        reason = None
        for extractor in (primary, fallback):
            if extractor is None:
                continue
            try:
                text = one(extractor, content or b"")
            except Exception as e:  # an unreadable document must not end the job
                reason = str(e)
                continue
            if text:
                return text, None
            reason = None
        return (None, reason) if reason is not None else ("", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = batch.column("error").to_pylist()
            results = [
                (None, e) if e is not None else text_of(c.as_py())
                for c, e in zip(batch.column("content"), errors)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "path": batch.column("path"),
                    "text": pa.array([t for t, _ in results], pa.string()),
                    "error": pa.array([e for _, e in results], pa.string()),
                }
            )

    raw = documents.select("path", "content", "error").mapInArrow(
        run, "path string, text string, error string"
    )
    return raw.withColumn("text", F.when(F.col("error").isNull(), clean_text(F.col("text"))))


def describe_texts(extracted: DataFrame) -> DataFrame:
    """Names, fingerprint, size and preview of extracted texts."""
    return extracted.select(
        base_name(F.col("path")).alias("name"),
        base_stem(F.col("path")).alias("stem"),
        fingerprint(F.col("text")).alias("text_hash"),
        F.length("text").alias("n_chars"),
        preview(F.col("text")).alias("preview"),
        "error",
    )


_DROPPED = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|p|div|h[1-6]|li|tr)\b[^>]*>")
_TAG = re.compile(r"(?s)<[^>]*>")


def html_pages(content: bytes) -> list[str]:
    """A plain extractor for HTML documents: block elements are its pages."""
    import html

    text = _DROPPED.sub(" ", content.decode("utf-8"))
    return [
        html.unescape(_TAG.sub("", part)).strip()
        for part in _BREAK.split(text)
        if _TAG.sub("", part).strip()
    ]
