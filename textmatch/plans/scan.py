"""Scanning a folder of documents in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.functions.text import base_name
from textmatch.sources.documents import (
    Extractor,
    extract_text,
    reject_unsupported,
    scan_folder,
)


def process_documents(
    documents: DataFrame,
    matcher: Callable[[DataFrame], DataFrame],
    primary: Extractor,
    fallback: Extractor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, matches)`` of files given as ``(path, content)``.

    The first is ``(query_id, text, error)`` with failed documents kept; only the others
    are matched. Extraction runs once, whatever reads it later.
    """
    extracted = materialize(
        extract_text(reject_unsupported(documents), primary, fallback), "extracted"
    ).select(base_name(F.col("path")).alias("query_id"), "text", "error")
    readable = extracted.filter(F.col("error").isNull()).select("query_id", "text")
    return extracted, matcher(readable)


def scan_documents(
    spark: SparkSession,
    folder: str,
    matcher: Callable[[DataFrame], DataFrame],
    primary: Extractor,
    fallback: Extractor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """:func:`process_documents` over the supported files of a folder."""
    return process_documents(scan_folder(spark, folder), matcher, primary, fallback)
