"""The stored index: corpus, vocabulary, vectors, embeddings, settings, fingerprint.

Every table carries the record id; nothing depends on row positions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import EngineConfig
from textmatch.operators.tfidf import TfidfModel, vocabulary
from textmatch.plans.match import EncoderFactory, embed
from textmatch.sources.sinks import write_table
from textmatch.sources.tables import require_files


@dataclass(frozen=True)
class Index:
    """A loaded index with the settings it was built with; pass its parts to the match plans."""

    corpus: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    embeddings: DataFrame
    model: TfidfModel
    cfg: EngineConfig


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    """One row that changes with any value of any column, whatever the row order."""
    marked = [
        F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~"))
        for c in sorted(corpus.columns)
    ]
    digest = F.md5(F.concat_ws("\x1f", *marked))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return corpus.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).cast("bigint").alias("hash_xor"),
        F.coalesce(F.sum(F.pmod("h", F.lit(1_000_003))), F.lit(0)).cast("bigint").alias("hash_sum"),
    )


def build_index(
    corpus: DataFrame,
    path: str,
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
    encoder: EncoderFactory | None = None,
    use_chunking: bool = True,
    encoder_name: str | None = None,
) -> Index:
    """Write every table of the index under ``path`` and load it."""
    spark = corpus.sparkSession
    name = encoder_identity(encoder, encoder_name)
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus")
    vocabulary(corpus, "embedding_text", cfg, stop_words).write.mode("overwrite").parquet(
        f"{path}/vocab"
    )
    model = TfidfModel(spark.read.parquet(f"{path}/vocab"), cfg, stop_words)
    write_table(
        corpus.select("id", model.vector(F.col("embedding_text")).alias("vector")),
        f"{path}/vectors",
        {"max_features": cfg.max_features},
    )
    embedded = embed(corpus, model, "embedding_text", cfg, encoder, use_chunking)
    write_table(
        embedded.select("id", "embedding"),
        f"{path}/embeddings",
        {
            "model_name": name,
            "embedding_dim": cfg.dim,
            "chunking_enabled": use_chunking,
            "chunk_size": cfg.chunk_size,
            "chunk_overlap": cfg.chunk_overlap,
        },
    )
    kept = {"cfg": asdict(cfg), "stop_words": None if stop_words is None else list(stop_words)}
    settings = spark.createDataFrame([(json.dumps(kept),)], "settings string")
    settings.write.mode("overwrite").parquet(f"{path}/settings")
    # Written last: an index without it is not complete and will not be reused.
    corpus_fingerprint(corpus).write.mode("overwrite").parquet(f"{path}/fingerprint")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    """The stored index with the settings it was built with, or an error naming what is
    missing."""
    parts = ["corpus", "vocab", "vectors", "embeddings", "settings", "fingerprint"]
    require_files(spark, [f"{path}/{p}/_SUCCESS" for p in parts])
    corpus, vocab, vectors, embeddings = (
        spark.read.parquet(f"{path}/{p}") for p in parts[:4]
    )
    kept = json.loads(spark.read.parquet(f"{path}/settings").first().settings)
    lists = {k: tuple(v) if isinstance(v, list) else v for k, v in kept["cfg"].items()}
    cfg = EngineConfig(**lists)
    model = TfidfModel(vocab, cfg, kept["stop_words"])
    return Index(corpus, vocab, vectors, embeddings, model, cfg)


def encoder_identity(encoder: EncoderFactory | None, encoder_name: str | None) -> str:
    """What stands for an encoder in a version: its name must be given."""
    if encoder is not None and not encoder_name:
        raise ValueError("give encoder_name: it tells one user encoder from another")
    return encoder_name or "hashing"


def index_version(
    corpus: DataFrame,
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
    encoder_name: str = "hashing",
    use_chunking: bool = True,
) -> str:
    """A folder name that stands for the corpus, the settings and the encoder."""
    words = None if stop_words is None else sorted(stop_words)
    parts = [*corpus_fingerprint(corpus).first(), cfg, words, encoder_name, use_chunking]
    return hashlib.md5(repr(parts).encode()).hexdigest()[:16]


def open_index(
    corpus: DataFrame,
    path: str,
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
    encoder: EncoderFactory | None = None,
    encoder_name: str | None = None,
    use_chunking: bool = True,
) -> Index:
    """Reuse the index built from this very corpus and settings, else build it.

    Each version has its own folder under ``path``: building one never touches what a
    running job reads.
    """
    spark = corpus.sparkSession
    name = encoder_identity(encoder, encoder_name)
    folder = f"{path}/{index_version(corpus, cfg, stop_words, name, use_chunking)}"
    try:
        return load_index(spark, folder)
    except FileNotFoundError:
        return build_index(corpus, folder, cfg, stop_words, encoder, use_chunking, encoder_name)
