from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (id, text[, lang, source]) rows to a documents table with awkward columns."""

    def make(rows, extra=()):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("text", T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()),
                *[T.StructField(c, T.StringType()) for c in extra],
            ]
        )
        full = []
        for r in rows:
            r = (*r, *["en", "s"][len(r) - 2 :])
            full.append((*r, None if r[1] is None else len(r[1]), *["x"] * len(extra)))
        return spark.createDataFrame(full, schema)

    return make
