"""Mapping titles to items by shared words.

Candidates come from rare words only. The words of a title that any item has are put in order of
rarity. An item that shares ``m`` words with a title of ``n`` such words has at least one of the
``n - m + 1`` rarest among them, so frequent words never have to meet:

1. The rarest word gives the first candidates, whose overlaps are counted exactly; the best of
   them, or two, is ``m``.
2. The words that are still needed for an overlap of ``m`` give the rest. A pair is looked at
   under its rarest common word only.
3. If no overlap reaches two, the first item listed under any of the words is the best; one row
   per word holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.functions.text import WS, hash_id


def title_words(title: Column) -> Column:
    """The distinct words of a title, in lower case."""
    words = F.split(F.lower(title), f"{WS}+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def overlap_score(a: Column, b: Column) -> Column:
    """Number of words two titles share."""
    return F.size(F.array_intersect(title_words(a), title_words(b)))


def title_map(items: DataFrame) -> DataFrame:
    """``(title, item_id, seq)`` per lower-case title: the last item, at the first place.

    ``items`` is ``(item_id, title, seq)`` with ``seq`` the listing order.
    """
    return items.groupBy(F.lower("title").alias("title")).agg(
        F.max_by("item_id", "seq").alias("item_id"), F.min("seq").alias("seq")
    )


def _met(asked: DataFrame, prefix: Column, listed: DataFrame) -> DataFrame:
    """(title, overlap, seq) of the items that have a word of ``prefix`` as the rarest one they
    share with the title; ``known`` holds the title's words, rarest first."""
    pairs = asked.select("title", "known", F.explode(prefix).alias("word")).join(listed, "word")
    shared = F.array_intersect("known", "words")
    return pairs.where(F.element_at(shared, 1) == F.col("word")).select("title", F.size(shared).alias("overlap"), "seq")


def overlap_candidates(titles: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(title, overlap, seq)``: the items that were compared with each distinct lower-case
    title, among them the best one, if any shares a word; ``mapping`` as in
    :func:`best_overlap`."""
    wanted = titles.select(F.lower("title").alias("title")).distinct()
    items = mapping.select("seq", title_words(F.col("title")).alias("words"))
    listed = items.select(F.explode("words").alias("word"), "seq", "words")
    rarity = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    own = wanted.select("title", F.explode(title_words(F.col("title"))).alias("word")).join(rarity, "word")
    asked = own.groupBy("title").agg(
        F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"), F.min("first").alias("first")
    )
    asked = materialize(asked.select("title", F.col("w.word").alias("known"), "first"), "asked")
    two = asked.where(F.size("known") > 1)
    rarest = materialize(_met(two, F.slice("known", 1, 1), listed), "rarest")
    reached = rarest.groupBy("title").agg(F.max("overlap").alias("reached"))
    more = two.join(reached, "title", "left")
    # Of the n - m + 1 rarest words the first has been looked at.
    left = F.size("known") - F.greatest(F.coalesce("reached", F.lit(2)), F.lit(2))
    rest = _met(more.where(left > 0), F.slice("known", F.lit(2), left), listed)
    one = asked.select("title", F.lit(1).alias("overlap"), F.col("first").alias("seq"))
    return rarest.unionByName(rest).unionByName(one)


def best_overlap(titles: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(title, item_id, overlap)`` per distinct lower-case title: the item sharing the
    most words, the first listed on ties, or a hashed id when none shares any.

    ``mapping`` comes from :func:`title_map`, best as a written table: it is read four times.
    """
    titles = materialize(titles.select(F.lower("title").alias("title")).distinct(), "wanted")
    best = overlap_candidates(titles, mapping).groupBy("title").agg(
        F.min(F.struct((-F.col("overlap")).alias("minus"), "seq")).alias("best")
    )
    best = best.select("title", (-F.col("best.minus")).alias("overlap"), "best.seq")
    found = best.join(mapping.select("seq", "item_id"), "seq")
    return titles.join(found, "title", "left").select(
        "title",
        F.coalesce("item_id", hash_id(F.col("title"))).alias("item_id"),
        F.coalesce("overlap", F.lit(0)).alias("overlap"),
    )
