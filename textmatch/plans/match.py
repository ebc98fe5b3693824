"""Matching documents against a corpus.

A corpus here is ``(id, title, embedding_text)`` with standardised titles; queries are
``(query_id, text)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, ship_package, small_batches
from textmatch.functions.text import clean_text
from textmatch.operators.chunking import chunk_text
from textmatch.operators.ranking import present_matches
from textmatch.operators.similarity import top_k
from textmatch.operators.tfidf import TfidfModel, boost_text, pool_unit

# Makes, once per worker process, a function from texts to vectors of equal length.
EncoderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]


def text_queries(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A few texts given in the program as queries."""
    return spark.createDataFrame(list(texts.items()), "query_id string, text string")


def boosted(df: DataFrame, model: TfidfModel, text: str, cfg: EngineConfig) -> DataFrame:
    """Replace ``text`` by itself with its heaviest terms appended."""
    # One term more than is appended tells a longer vector from one that is appended whole.
    weighted = df.withColumn("_vector", model.vector(F.col(text), cfg.boost_terms + 1))
    new = boost_text(F.col(text), F.col("_vector"), cfg.boost_terms, cfg.boost_sep)
    return weighted.withColumn(text, new).drop("_vector")


def encode_chunks(chunks: Column, encoder: EncoderFactory, batch_size: int = 32) -> Column:
    """Pooled unit vectors of a user's encoder; the model is made once per worker and is
    given ``batch_size`` texts at a time."""
    ship_package()
    small_batches(SparkSession.active())

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for batch in batches:
            lists = [list(x) for x in batch]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = [text for x in lists for text in x]
            if not flat:
                yield pd.Series([None] * len(lists), dtype=object)
                continue
            parts = [run(flat[i : i + batch_size]) for i in range(0, len(flat), batch_size)]
            vectors = np.concatenate([np.asarray(p, dtype=float) for p in parts])
            pooled = pool_unit(vectors, owner, len(lists)).astype(np.float32)
            yield pd.Series(list(pooled))

    return encode(chunks)


def embed(
    df: DataFrame,
    model: TfidfModel,
    text: str = "text",
    cfg: EngineConfig = EngineConfig(),
    encoder: EncoderFactory | None = None,
    use_chunking: bool = True,
) -> DataFrame:
    """Add ``embedding``: boost, chunk, encode, average, scale. All within the row."""
    df = df.withColumn("_text", F.col(text))
    df = boosted(df, model, "_text", cfg)
    chunks = chunk_text(F.col("_text"), cfg) if use_chunking else F.array("_text")
    df = df.withColumn("_chunks", chunks)
    value = F.col("_chunks")
    if encoder is None:
        vector = model.embedding(value)
    else:
        vector = encode_chunks(value, encoder, cfg.encode_batch)
    return df.withColumn("embedding", vector).drop("_text", "_chunks")


def match_documents(
    queries: DataFrame,
    corpus: DataFrame,
    model: TfidfModel,
    cfg: EngineConfig = EngineConfig(),
    embeddings: DataFrame | None = None,
    encoder: EncoderFactory | None = None,
    use_chunking: bool = True,
) -> DataFrame:
    """The ``top_n`` corpus rows per query by embedding, one per normalised title.

    ``embeddings`` is a stored ``(id, embedding)`` table; without it the corpus is embedded
    on the way.
    """
    if embeddings is None:
        embeddings = embed(corpus, model, "embedding_text", cfg, encoder, use_chunking)
    cleaned = queries.select("query_id", clean_text(F.col("text")).alias("text"))
    asked = embed(cleaned, model, "text", cfg, encoder, use_chunking)
    candidates = top_k(
        asked.select("query_id", F.col("embedding").alias("vector")),
        embeddings.select("id", F.col("embedding").alias("vector")),
        cfg.overfetch * cfg.top_n,
    )
    return present_matches(candidates, corpus, cfg.top_n)


def match_lite(
    queries: DataFrame,
    corpus: DataFrame,
    model: TfidfModel,
    cfg: EngineConfig = EngineConfig(),
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The same by TF-IDF alone: mean chunk vector of the boosted query against the
    document vectors, one row per lower-case title."""
    if vectors is None:
        vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    cleaned = queries.select("query_id", clean_text(F.col("text")).alias("text"))
    asked = boosted(cleaned, model, "text", cfg).withColumn(
        "_chunks", chunk_text(F.col("text"), cfg)
    )
    candidates = top_k(
        asked.select("query_id", model.mean_vector(F.col("_chunks")).alias("vector")),
        vectors.select("id", "vector"),
        cfg.overfetch * cfg.top_n,
        "sparse_cosine",
    )
    return present_matches(candidates, corpus, cfg.top_n, "lite")


def similar_documents(
    queries: DataFrame, corpus: DataFrame, model: TfidfModel, k: int
) -> DataFrame:
    """``(query_id, id, score, rank)`` by the cosine of plain TF-IDF vectors."""
    return top_k(
        queries.select("query_id", model.vector(clean_text(F.col("text"))).alias("vector")),
        corpus.select("id", model.vector(F.col("embedding_text")).alias("vector")),
        k,
        "sparse_cosine",
    )


def with_average(matches: DataFrame) -> DataFrame:
    """Matches next to their query's average similarity; a query has a few rows only."""
    mean = F.avg("similarity_percentage").over(Window.partitionBy("query_id"))
    return matches.withColumn("avg_similarity", mean)
