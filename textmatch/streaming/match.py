"""Matching documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textmatch.config import EngineConfig
from textmatch.plans.match import match_documents, match_lite
from textmatch.sources.index import Index

Matcher = Callable[[DataFrame], DataFrame]


def index_matcher(
    index: Index, cfg: EngineConfig = EngineConfig(), lite: bool = False
) -> Matcher:
    """Queries to matches against a stored index. Of ``cfg`` only the length of the lists
    counts; all that shaped the stored vectors comes from the index."""
    cfg = replace(index.cfg, top_n=cfg.top_n, overfetch=cfg.overfetch)
    if lite:
        return lambda q: match_lite(q, index.corpus, index.model, cfg, index.vectors)
    return lambda q: match_documents(q, index.corpus, index.model, cfg, index.embeddings)


def match_stream(
    documents: DataFrame,
    matcher: Matcher,
    out: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start a query that matches each micro-batch of ``(query_id, text)``.

    The plan is the batch plan and keeps no state. A batch writes its own folder, replacing
    what an earlier attempt at it left, so a repeated batch does not repeat rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        matcher(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
