"""Overlapping text chunks.

A text longer than the window becomes windows of it. A window that isn't the last ends at the
last blank after its first character, or at full length without one; the next begins
``overlap`` characters before that end, and at least one further on, as long as it begins inside
the text. Chunks are trimmed, and empty ones left out. A text that fits in the window is its only chunk, as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, ship_package

CHARS_PER_TOKEN = 4
TABLE_FUNCTION = "text_chunks"


def spans(text: str, window: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a long text; an end may lie beyond the text.

    The places of all blanks are found once; the end of a window is looked up among them.
    """
    blanks = [m.start() for m in re.finditer(" ", text)]

    def end_of(start: int) -> int:
        full = start + window
        last = bisect_left(blanks, full) - 1
        return blanks[last] if full < len(text) and last >= 0 and blanks[last] > start else full

    found = [(0, end_of(0))]
    while (start := max(found[-1][0] + 1, found[-1][1] - overlap)) < len(text):
        found.append((start, end_of(start)))
    return found


def chunks(text: str | None, window: int, overlap: int) -> list[str]:
    """The trimmed windows; a short text isn't trimmed, and null is an empty text."""
    text = text or ""
    if len(text) <= window:
        return [text]
    return [piece for low, high in spans(text, window, overlap) if (piece := text[low:high].strip())]


def _sizes(cfg: EngineConfig) -> tuple[int, int]:
    return cfg.chunk_size * CHARS_PER_TOKEN, cfg.chunk_overlap * CHARS_PER_TOKEN


def chunk_text(text: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """``array<string>``: the chunks of a text, for steps that go on within the row."""
    ship_package()
    window, overlap = _sizes(cfg)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t, window, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return split(F.coalesce(text, F.lit("")))


@F.udtf(returnType="chunk_idx int, chunk string")
class ChunkRows:
    """Table function (text, window, overlap): a row for each chunk of a text."""

    def eval(self, text: str, window: int, overlap: int):
        for pair in enumerate(chunks(text, window, overlap)):
            yield pair


def register_chunks(spark: SparkSession, name: str = TABLE_FUNCTION) -> str:
    """Make the table function known to SQL: ``FROM docs, LATERAL text_chunks(text, 2048, 200)``."""
    ship_package(spark)
    spark.udtf.register(name, ChunkRows)
    return name


def chunk_docs(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """``(id, chunk_idx, chunk)``, one row per chunk, by the table function."""
    ship_package(docs.sparkSession)
    window, overlap = map(F.lit, _sizes(cfg))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_body"))
    made = ChunkRows(F.col("_body").outer(), window, overlap)
    return rows.lateralJoin(made).select(id_col, "chunk_idx", "chunk")
