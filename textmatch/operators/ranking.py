"""From scored candidates to the list a user sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.functions.text import percentage
from textmatch.functions.titles import normalize_title, normalize_title_lite

def dedup_titles(
    matches: DataFrame,
    n: int | None = None,
    profile: str = "full",
    by: str = "query_id",
    id_col: str = "id",
    value: str = "similarity_percentage",
) -> DataFrame:
    """Per query, the best row of each normalised title; with ``n``, the best ``n`` of
    these with their ``rank``.

    Titles are taken as standardised. A table without a title passes unchanged. Ordering
    is by ``value``, then by score where there is one, then by id.
    """
    if "title" not in matches.columns:
        return matches
    key = (
        normalize_title(F.col("title"), standardized=True)
        if profile == "full"
        else normalize_title_lite(F.col("title"))
    )
    order = [F.desc(value)]
    if "score" in matches.columns and value != "score":
        order.append(F.desc(F.floor(F.col("score") * 1000000 + 0.5)))
    order.append(F.col(id_col))
    best = Window.partitionBy(by, "normalized_title").orderBy(*order)
    kept = (
        matches.withColumn("normalized_title", key)
        .withColumn("copy", F.row_number().over(best))
        .filter(F.col("copy") == 1)
        .drop("copy", "normalized_title", "rank")
    )
    if n is None:
        return kept
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return kept.withColumn("rank", place).filter(F.col("rank") <= n)


def present_matches(
    candidates: DataFrame, corpus: DataFrame, n: int, profile: str = "full"
) -> DataFrame:
    """Attach titles to the candidates, as percentages, keep the best ``n``, then fetch texts.

    Texts are fetched for the rows that are shown only, by a plain join on the id.
    """
    found = candidates.select("query_id", "id", "score").join(corpus.select("id", "title"), "id")
    found = found.withColumn("similarity_percentage", percentage(F.col("score")))
    best = dedup_titles(found, n, profile)
    return best.join(corpus.select("id", "embedding_text"), "id").select(
        "query_id", "rank", "id", "title", "similarity_percentage", "embedding_text", "score"
    )


def rank_results(
    results: DataFrame, depth: int | None = None, query: str = "query_id"
) -> DataFrame:
    """``rank`` from 1 by score, ties by item id, down to ``depth`` or to the end.

    A full list may be any share of the table, and any share of it may have one score. Rows are
    dealt by ranges of (query, score, item), which are sorted apart; the part of a list in a range
    begins where the parts before it end.
    """
    order = [F.desc("score"), F.col("item_id")]
    if depth is not None:
        place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
        return results.withColumn("rank", place).filter(F.col("rank") <= depth)
    # Ranges are found on a sample: what gives the scores shouldn't run twice.
    dealt = materialize(rank_ranges(materialize(results, "scored"), query), "dealt")
    sizes = dealt.groupBy(query, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(query).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(query, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(query, "_range").orderBy(*order))
    ranked = dealt.withColumn("_inside", inside).join(starts, [query, "_range"])
    return ranked.withColumn("rank", (F.col("_start") + F.col("_inside")).cast("bigint")).drop(
        "_range", "_inside", "_start"
    )


def rank_ranges(results: DataFrame, query: str = "query_id") -> DataFrame:
    """``results`` with ``_range``: rows in equal shares, in the order of (query, rank)."""
    dealt = results.repartitionByRange(F.col(query), F.desc("score"), F.col("item_id"))
    return dealt.withColumn("_range", F.spark_partition_id())
