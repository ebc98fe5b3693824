"""Spans of documents: joining neighbours, and cutting them out of texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import rows_with


def cut_spans(
    docs: DataFrame,
    spans: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """``docs`` without the characters in ``spans`` (id, start, end; code points).

    The spans of one document are gathered, never those of several; a null id has none.
    """
    mine = spans.groupBy(F.col(id_col).alias("_span_id")).agg(
        F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_spans")
    )
    joined = docs.join(mine, F.col(id_col) == F.col("_span_id"), "left").drop("_span_id")

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for text, found in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            if text is not None and found:
                pieces, at = [], 0
                for s in sorted(found, key=lambda s: s["a"]):
                    pieces.append(text[at : max(at, s["a"])])
                    at = max(at, s["b"])
                text = "".join([*pieces, text[at:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    field = T.StructField(text_col, T.StringType())
    return rows_with(joined, [text_col, "_spans"], [field], run, carry=docs.columns)
