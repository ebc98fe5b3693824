"""Seeded samples for evaluation without expert truth.

Draws are hashes of the seed and the key, so a lost task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import hash32


def _numbered(df: DataFrame, order: list, n: int, start: int) -> DataFrame:
    """The first ``n`` rows with a number; ``n`` is a small setting, not a data size."""
    place = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("i", F.row_number().over(place) + start - 1)


def sample_truth(
    corpus: DataFrame, n_queries: int = 10, n_items: int = 20, seed: int = 42
) -> DataFrame:
    """``(query_id, item_id, item_title, seq, relevance)``: random grades 0 to 3.

    The items are the first distinct titles of the corpus, repeated while there are fewer
    than asked for. Grades 0, 1, 2 and 3 are drawn with weights 0.4, 0.3, 0.2 and 0.1.
    """
    titles = corpus.groupBy("title").agg(F.min("id").alias("first_id"))
    first = _numbered(titles, ["first_id", "title"], n_items, 0)
    size = F.count(F.lit(1)).over(Window.partitionBy())
    repeats = F.explode(
        F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_items - 1)),
                lambda r: F.col("i") + r * F.col("size"),
            ),
            lambda x: x < n_items,
        )
    )
    items = first.withColumn("size", size.cast("int")).select(
        repeats.alias("n"), F.col("title").alias("item_title")
    )
    draw = (
        hash32(F.concat_ws("|", F.lit(str(seed)), F.col("query_id"), F.col("item_id")))
        / 4294967296.0
    )
    grade = F.when(draw < 0.4, 0.0).when(draw < 0.7, 1.0).when(draw < 0.9, 2.0).otherwise(3.0)
    return (
        items.select(
            F.explode(F.sequence(F.lit(1), F.lit(n_queries))).alias("q"), "n", "item_title"
        )
        .select(
            F.concat(F.lit("resume_"), F.col("q")).alias("query_id"),
            F.concat(F.lit("job_"), F.col("n")).alias("item_id"),
            "item_title",
            F.col("n").alias("seq"),
        )
        .withColumn("relevance", grade)
    )


def sample_texts(corpus: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``(query_id, text)``: ``n`` corpus texts drawn by hash, for queries 1 to ``n``."""
    drawn = corpus.select(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))).alias("draw"),
        "id",
        F.col("embedding_text").alias("text"),
    )
    return _numbered(drawn, ["draw", "id"], n, 1).select(
        F.concat(F.lit("resume_"), F.col("i")).alias("query_id"), "text"
    )
