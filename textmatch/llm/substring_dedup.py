"""Repeated passages by hashing the units of lines, with offsets into the original text.

A unit is a line or, with ``sentences``, a line cut after ``.``, ``!`` and ``?``, so that a
passage in the middle of a line is found too. A unit is compared by the 128-bit digest of its
words, A-Z lower-cased, blanks collapsed. Digests are grouped globally (combined on the map
side); the earliest occurrence, by document id and then place, stays and all others are
marked. Marked units that are neighbours in their document, and whose first occurrences are
neighbours too, make one passage; with ``by_pairs`` it is enough that the two are neighbours in
any earlier place, so a unit that first occurred elsewhere doesn't cut a copied passage. For
that, the pairs that begin with a repeated unit are grouped as the units are, and the pairs at
which a passage ends and another begins are looked up among them. A passage of
``min_words`` words or more is removed. Shorter ones stay: a greeting, a common phrase, a
license line after a common heading.

A text goes once through Arrow to be cut into units; then only digests, ids and offsets move.
Digests with a large part of all units are joined by broadcast (a bounded number), all others
by shuffle; the units gathered in one place are those of one document.

Defined results: a null, an empty or a blank text has no units. Equal texts are repeated from
their first row on; rows that repeat an id and text count as one. A null id ranks last. An
empty table gives no rows. Extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textmatch.config import materialize
from textmatch.llm.common import join_groups, place, place_at, place_id, rows_with, table

MIN_WORDS = 20
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^\n.!?]+(?:[.!?](?=[^\s.!?])[^\n.!?]*)*[.!?]*|[.!?]+")


def units(text: str | None, sentences: bool = True) -> list[tuple[bytes, int, int, int]]:
    """(digest, start, end, words) of each unit that has a word; offsets are code points."""
    from xxhash import xxh3_128_digest

    out = []
    for match in (SENTENCE if sentences else LINE).finditer(text or ""):
        raw = match.group()
        words = raw.encode().lower().split()
        if words:
            start = match.start() + len(raw) - len(raw.lstrip("\t\n\x0b\x0c\r "))
            end = match.end() - (len(raw) - len(raw.rstrip("\t\n\x0b\x0c\r ")))
            out.append((xxh3_128_digest(b" ".join(words)), start, end, len(words)))
    return out


_UNIT = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("again", T.BooleanType()),
        T.StructField("next", T.LongType()),
    ]
)


# ``at``, ``digest`` and ``next`` are those of the last unit, if another run begins after it.
_RUNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("n_units", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("first_id", T.LongType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("next", T.LongType()),
        ]
    )
)


def _all_units(docs: DataFrame, id_col: str, text_col: str, sentences: bool) -> DataFrame:
    """(id, content, at, digest, start, end, words, again, next); ``again``: not the first in its
    text; ``next``: half the digest of the following unit."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        kind = pa.list_(
            pa.struct(
                [
                    ("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32()),
                    ("words", pa.int32()), ("again", pa.bool_()), ("next", pa.int64()),
                ]
            )
        )
        out = []
        for text in columns[0].to_pylist():
            seen: set[bytes] = set()
            mine = []
            for digest, start, end, words in units(text, sentences):
                if mine:
                    mine[-1]["next"] = int.from_bytes(digest[:8], "big", signed=True)
                mine.append(
                    {
                        "digest": digest, "start": start, "end": end, "words": words,
                        "again": digest in seen, "next": None,
                    }
                )
                seen.add(digest)
            out.append(mine)
        return [pa.array(out, kind)]

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("body")
    )
    cut = rows_with(
        rows, ["body"], [T.StructField("units", T.ArrayType(_UNIT))], run, carry=["id", "content"]
    )
    return cut.select("id", "content", F.posexplode("units").alias("at", "u")).select(
        "id", "content", "at", "u.*"
    )


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    sentences: bool = True,
    by_pairs: bool = False,
) -> DataFrame:
    """(id, start, end, n_units, n_words, first_id): the passages to remove.

    ``first_id`` is the document with the earliest occurrence of the passage's units; with
    ``by_pairs``, of the units of its longest part that has one.
    """
    found = materialize(_all_units(docs, id_col, text_col, sentences), "units")
    groups = found.groupBy("digest").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select(
        "digest", "n", place_at("first").cast("int").alias("first_at"),
        place_id("first").alias("first_id"),
    )
    groups = materialize(groups, "repeated")
    repeated = join_groups(found, groups, ["digest"], found.count())
    if by_pairs:
        repeated = materialize(repeated, "members")
    marked = repeated.where(F.col("again") | ~F.col("id").eqNullSafe(F.col("first_id")))
    # The marked units of one document.
    unit = F.struct("at", "start", "end", "words", "first_id", "first_at", "digest", "next")
    mine = marked.groupBy("id", "content").agg(F.array_sort(F.collect_set(unit)).alias("units"))

    def runs_of(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for row in columns[0].to_pylist():
            runs: list[dict] = []
            last = None
            for u in row:
                if last is not None and _goes_on(last, u):
                    run = runs[-1]
                    run["end"], run["n_units"] = u["end"], run["n_units"] + 1
                    run["n_words"] += u["words"]
                else:
                    if by_pairs and last is not None and u["at"] == last["at"] + 1:
                        runs[-1].update(at=last["at"], digest=last["digest"], next=last["next"])
                    runs.append(
                        {
                            "start": u["start"], "end": u["end"], "n_units": 1,
                            "n_words": u["words"], "first_id": u["first_id"],
                        }
                    )
                last = u
            # A short one may grow where it meets another.
            meets = ["at" in r for r in runs]
            grow = [a or b for a, b in zip(meets, [False, *meets])]
            out.append([r for r, g in zip(runs, grow) if g or r["n_words"] >= min_words])
        return [pa.array(out, to_arrow_type(_RUNS))]

    runs = rows_with(mine, ["units"], [T.StructField("runs", _RUNS)], runs_of, carry=["id", "content"])
    if by_pairs:
        runs = _linked(materialize(runs, "runs"), repeated, min_words)
    return runs.select("id", F.inline("runs")).select("id", "start", "end", "n_units", "n_words", "first_id")


def _goes_on(last: dict, unit: dict) -> bool:
    """Whether two marked units are neighbours here and where they first occur, or the second
    repeats the first."""
    if unit["at"] != last["at"] + 1 or unit["first_id"] is None or unit["first_id"] != last["first_id"]:
        return False
    return unit["first_at"] - last["first_at"] in (0, 1)


def _linked(runs: DataFrame, repeated: DataFrame, min_words: int) -> DataFrame:
    """(id, content, runs), with neighbouring runs as one if the pair of units at which they meet
    has an earlier place."""
    meet = runs.select("id", "content", F.inline("runs")).where("next IS NOT NULL")
    meet = meet.select("id", "content", "at", "digest", "next")
    pairs = repeated.where("next IS NOT NULL").groupBy("digest", "next")
    pairs = pairs.agg(F.min(place()).alias("pair"), F.count("*").alias("n")).where("n > 1")
    pairs = materialize(pairs, "pairs")
    links = join_groups(meet, pairs, ["digest", "next"], repeated.count())
    links = links.where(~place().eqNullSafe(F.col("pair"))).select("id", "content", "at")
    both = runs.withColumn("at", F.lit(None).cast("int")).unionByName(
        links.withColumn("runs", F.lit(None).cast(_RUNS))
    )
    both = both.groupBy("id", "content").agg(
        F.first("runs", ignorenulls=True).alias("runs"), F.collect_set("at").alias("links")
    )

    def join(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for row, links in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            held, whole, last = set(links), [], None
            for r in row:
                if last is not None and last["at"] in held:
                    run = whole[-1]
                    run["end"], run["n_units"] = r["end"], run["n_units"] + r["n_units"]
                    run["n_words"] += r["n_words"]
                    if r["n_words"] > run["longest"]:
                        run["longest"], run["first_id"] = r["n_words"], r["first_id"]
                else:
                    whole.append({**r, "longest": r["n_words"]})
                last = r
            names = ("start", "end", "n_units", "n_words", "first_id")
            out.append([{n: r[n] for n in names} for r in whole if r["n_words"] >= min_words])
        return [pa.array(out, to_arrow_type(_RUNS))]

    return rows_with(both, ["runs", "links"], [T.StructField("runs", _RUNS)], join, carry=["id", "content"])


def op7_substring_dedup(spark, sf_dir):
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), by_pairs=True)
    return found.select(
        F.col("id").alias("doc_id"), "start", "end", "n_units", "n_words",
        F.col("first_id").alias("first_doc_id"),
    )
