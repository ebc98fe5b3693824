"""Tokens, n-grams and per-document term counts, without leaving the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmatch.functions.stopwords import ENGLISH
from textmatch.functions.text import WORD, let


def default_stop_words() -> tuple[str, ...]:
    """Spark's own English list; pass another list to any operator to replace it."""
    return ENGLISH


def all_words(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))


# What is in no word, with the ASCII characters one by one: Java looks these up in a table.
_ASCII = "".join(rf"\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i) == "_"))
_OUTSIDE = rf"[{_ASCII}[\x{{80}}-\x{{10ffff}}&&[^{WORD}]]]+"


def spaced_words(text: Column) -> Column:
    """The lower-case text with one blank for all between two words: for steps that cut it there.

    That takes less than half the time of :func:`all_words`, as a text stays one value. Its pieces
    of two or more characters are the words.
    """
    return F.regexp_replace(F.lower(text), _OUTSIDE, " ")


def words(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """The same without stop words."""
    stop = list(default_stop_words() if stop_words is None else stop_words)
    found = all_words(text)
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Blank-joined runs of ``low`` to ``high`` neighbouring tokens."""

    def runs(t: Column, n: int) -> Column:
        if n == 1:
            return t
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        out = F.slice(t, F.lit(1), count)
        for shift in range(1, n):
            out = F.zip_with(
                out,
                F.slice(t, F.lit(1 + shift), count),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        return out

    return let(tokens, lambda t: F.concat(*[runs(t, n) for n in range(low, high + 1)]))


def terms(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """The unigrams and bigrams of a text."""
    return ngrams(words(text, stop_words))


def count_terms(items: Column) -> Column:
    """``array<struct<term, tf>>`` in term order, by sorting and measuring runs.

    Staying inside the row keeps a document's counts in its own task: no shuffle of
    exploded terms is needed to count them.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda p, j: F.struct(
                    F.get(s, p - 1).alias("term"),
                    (F.coalesce(F.get(b, j + 1), F.size(s) + 1) - p).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(
        F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty)
    )
