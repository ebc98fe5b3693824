"""Benchmark decontamination: a broadcast hash set of test n-grams over training texts.

Every benchmark item gives its windows of ``n`` neighbouring words (an item of fewer words is
one window). The windows, as numbers of a small vocabulary, and their hashes go to the executors
as a broadcast set; a document is one row of words, and a window whose hash is in the set is
compared word by word before it counts.

The set comes from some ``block_bytes`` of benchmark text at most; items longer than ``PIECE``
words are cut into pieces that share ``n - 1`` words, which have the same windows. A benchmark of
one block is one pass, in which no row is shuffled. A larger one is as many passes, one after
another: the driver and every worker hold one block at a time, each pass writes what it found by
the digest of the text and lets go of its block, and a last pass puts the finds of each text
together. Any size gives the same result.

Defined results: a null or empty text has no words and is clean. Benchmark rows without text
or words are ignored; a null item id is matched but not listed. Repeated items list their id
once; repeated documents are rows of their own. Other columns pass unchanged; a column named
as one of the results is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize
from textmatch.llm.common import join_groups, plain_words, rows_with, run_hashes, table, utf8

N = 10
BLOCK_BYTES = 4 << 20
PIECE = 1 << 16  # words of an item taken together
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Windows:
    """The windows of one block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                owners = found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), [])
                if item is not None and item not in owners:
                    owners.append(item)
        #: by length: sorted hashes, the windows in that order, and their items
        self.by_length = {}
        for size, windows in found.items():
            rows = np.array(list(windows), np.uint64)
            hashes = run_hashes(rows.reshape(-1), size)[::size]
            order = np.argsort(hashes, kind="stable")
            owners = list(windows.values())
            seen = np.zeros(1 << 16, bool)
            seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by_length[size] = (hashes[order], rows[order], [owners[i] for i in order], seen)

    def hits(self, words: list[bytes | None]) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Which words lie in a window, and (position, items) of each occurrence."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        edges = np.zeros(len(words) + 1, np.int64)
        found = []
        for size, (hashes, rows, owners, seen) in self.by_length.items():
            here = run_hashes(ids, size)
            at = np.flatnonzero(seen[(here & np.uint64(0xFFFF)).astype(np.int64)])
            first = np.searchsorted(hashes, here[at])
            last = np.searchsorted(hashes, here[at], side="right")
            for pos, low, high in zip(at[first < last], first[first < last], last[first < last]):
                for k in range(low, high):
                    if np.array_equal(ids[pos : pos + size], rows[k]):
                        edges[pos] += 1
                        edges[pos + size] -= 1
                        found.append((int(pos), owners[k]))
        return np.cumsum(edges[:-1]) > 0, found


def _pieces(bench: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item, body): the items, long ones in pieces with the same windows."""
    items = bench.select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body")
    ).where("body IS NOT NULL")

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for text in utf8(columns[0]):
            words = plain_words(text)
            starts = range(0, max(1, len(words) - n + 1), PIECE)
            out.append([b" ".join(words[i : i + PIECE + n - 1]).decode() for i in starts])
        return [pa.array(out, pa.list_(pa.string()))]

    made = rows_with(items, ["body"], [T.StructField("bodies", T.ArrayType(T.StringType()))], run, carry=["item"])
    return made.select("item", F.explode("bodies").alias("body")).where("body <> ''")


def _blocks(
    bench: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int
) -> tuple[int, Iterator[Windows]]:
    """How many bounded blocks the benchmark has, and one after another, a collect each."""
    pieces = _pieces(bench, item_col, text_col, n)
    total = pieces.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    count = max(1, -(-total // block_bytes))

    def each() -> Iterator[Windows]:
        for k in range(count):
            block = pieces.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k)
            yield Windows([(r.item, r.body.encode()) for r in block.collect()], n)

    return count, each()


def _found(windows: Windows, split: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each text the mask of its hit words, and the items that occur."""
    words: list[bytes | None] = []
    starts = []
    for w in split:
        starts.append(len(words))
        words += w
        words.append(None)  # no window spans two documents
    hit, found = windows.hits(words)
    items: list[set[str]] = [set() for _ in split]
    edges = np.array(starts, np.int64)
    for pos, owners in found:
        items[int(np.searchsorted(edges, pos, side="right")) - 1].update(owners)
    return [hit[start : start + len(w)] for w, start in zip(split, starts)], items


def _runs(mask: np.ndarray) -> list[dict[str, int]]:
    """(start, end) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULTS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(_SPAN)),
]


def _results(texts: list, split: list, masks: list, items: list) -> list[pa.Array]:
    counts = [int(m.sum()) for m in masks]
    spans = [_spans(t.decode(), m) if c else [] for t, m, c in zip(texts, masks, counts)]
    return [
        pa.array([len(w) for w in split], pa.int64()),
        pa.array(counts, pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(spans, _SPANS),
    ]


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    n: int = N,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (sorted ids) and ``hit_spans``.

    ``hit_spans`` are the (start, end) character offsets of runs of hit words.
    """
    count, blocks = _blocks(bench, item_col, bench_text_col, n, block_bytes)
    if count > 1:
        return _in_passes(docs, blocks, text_col)
    handle = docs.sparkSession.sparkContext.broadcast(next(blocks))

    def scan(columns: list[pa.Array]) -> list[pa.Array]:
        texts = utf8(columns[0])
        split = [plain_words(t) if t else [] for t in texts]
        return _results(texts, split, *_found(handle.value, split))

    return rows_with(docs, [text_col], _RESULTS, scan, slice_rows=256)


def _in_passes(docs: DataFrame, blocks: Iterator[Windows], text_col: str) -> DataFrame:
    """One pass over the documents for each block, and one that puts the finds together."""
    from xxhash import xxh3_128_digest

    context = docs.sparkSession.sparkContext
    fields = [
        T.StructField("digest", T.BinaryType()),
        T.StructField("runs", T.ArrayType(_SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    passes = []
    for windows in blocks:
        handle = context.broadcast(windows)

        def scan(columns: list[pa.Array], handle=handle) -> list[pa.Array]:
            texts = utf8(columns[0])
            split = [plain_words(t) if t else [] for t in texts]
            masks, items = _found(handle.value, split)
            return [
                pa.array([xxh3_128_digest(t) if t else None for t in texts], pa.binary()),
                pa.array([_runs(m) for m in masks], _SPANS),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]

        hits = rows_with(docs, [text_col], fields, scan, carry=[], slice_rows=256).where(F.size("runs") > 0)
        # Copies of a text have the same finds.
        hits = hits.groupBy("digest").agg(F.first("runs").alias("runs"), F.first("items").alias("items"), F.count("*").alias("n"))
        passes.append(materialize(hits, "hits"))
        handle.destroy()
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    found = found.groupBy("digest").agg(
        F.flatten(F.collect_list("runs")).alias("_runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"),
        F.max("n").alias("n"),
    )
    found = materialize(found.withColumnRenamed("digest", "_digest"), "found")

    def name(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([xxh3_128_digest(t or b"") for t in utf8(columns[0])], pa.binary())]

    named = rows_with(docs, [text_col], [T.StructField("_digest", T.BinaryType())], name, slice_rows=256)
    joined = join_groups(named, found, ["_digest"], docs.count(), "left")

    def together(columns: list[pa.Array]) -> list[pa.Array]:
        texts = utf8(columns[0])
        split = [plain_words(t) if t else [] for t in texts]
        masks = []
        for words, runs in zip(split, columns[1].to_pylist()):
            mask = np.zeros(len(words), bool)
            for r in runs or ():
                mask[r["start"] : r["end"]] = True
            masks.append(mask)
        return _results(texts, split, masks, [x or [] for x in columns[2].to_pylist()])

    return rows_with(joined, [text_col, "_runs", "_items"], _RESULTS, together, carry=docs.columns, slice_rows=256)


def _spans(text: str, mask: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of each run of hit words."""
    out: list[dict[str, int]] = []
    inside = False
    for hit, match in zip(mask, WORD.finditer(text)):
        if hit and inside:
            out[-1]["end"] = match.end()
        elif hit:
            out.append({"start": match.start(), "end": match.end()})
        inside = bool(hit)
    return out


def without_spans(text_col: str = "text", spans_col: str = "hit_spans"):
    """The text with its hit spans cut out and a line break in the place of each.

    Spans count code points. Repeat the scan if a document must stay clean after the cut.
    """
    text, spans = F.col(text_col), F.col(spans_col)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(
        F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint"))
    )
    pieces = F.zip_with(
        ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, "\n")).otherwise(text)


def op2_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# Words as arrays; windows as text. The same windows meet in an equi-join.
OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes
        WHERE len(w) >= n)),
occ AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM occ))
  GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
