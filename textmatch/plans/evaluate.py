"""Evaluating the matcher against graded truth."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, materialize
from textmatch.operators.metrics import averages, best_threshold, evaluate
from textmatch.operators.overlap import best_overlap, title_map
from textmatch.operators.sampling import sample_texts, sample_truth
from textmatch.operators.tfidf import TfidfModel
from textmatch.plans.match import match_documents


def ranking_from_matches(matches: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(query_id, rank, item_id, score)``: each matched title becomes the item whose
    title shares most words with it."""
    items = best_overlap(matches.select("title"), mapping)
    return (
        matches.withColumn("lower_title", F.lower("title"))
        .join(items.select(F.col("title").alias("lower_title"), "item_id"), "lower_title")
        .select(
            "query_id",
            "rank",
            "item_id",
            (F.col("similarity_percentage") / 100.0).alias("score"),
        )
    )


def evaluate_model(
    corpus: DataFrame,
    model: TfidfModel,
    truth: DataFrame | None = None,
    texts: DataFrame | None = None,
    cfg: EngineConfig = EngineConfig(),
    threshold: float | None = None,
    embeddings: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Average metrics ``(metric, k, threshold, value, queries)`` of the matcher.

    ``truth`` is ``(query_id, item_id, item_title, relevance)`` with an optional ``seq``,
    and ``texts`` is ``(query_id, text)``; samples stand in for what is not given. Without
    a threshold the one with the best F1 is used.
    """
    if truth is None:
        truth = materialize(sample_truth(corpus, seed=seed), "truth")
    if texts is None:
        asked = truth.select("query_id").distinct()
        texts = sample_texts(corpus, asked.count(), seed).join(asked, "query_id")
    listed = truth if "seq" in truth.columns else truth.withColumn("seq", F.col("item_id"))
    items = listed.groupBy("item_id").agg(
        F.max_by("item_title", "seq").alias("title"), F.min("seq").alias("seq")
    )
    mapping = materialize(title_map(items), "titles")
    wide = replace(cfg, top_n=max(cfg.k_values))
    matches = match_documents(texts, corpus, model, wide, embeddings)
    # A few rows per query that several aggregations read: written once.
    ranking = materialize(
        ranking_from_matches(materialize(matches, "matches"), mapping), "ranking"
    )
    thresholds = cfg.thresholds if threshold is None else (threshold,)
    per_query = evaluate(ranking, truth, cfg.k_values, thresholds)
    average = averages(per_query, cfg.k_values, thresholds)
    if threshold is not None:
        return average
    average = materialize(average, "averages")
    chosen = best_threshold(average, cfg.k_values).select("threshold").scalar()
    return average.filter(F.col("threshold").isNull() | (F.col("threshold") == chosen))
