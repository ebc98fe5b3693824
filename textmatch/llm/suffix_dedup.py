"""Repeated passages by a sparse suffix array over minimiser positions.

Words are runs without ASCII blanks, A-Z lower-cased. Of every ``GRAMS`` neighbouring runs of
``ANCHOR`` words the one with the least hash is an anchor, so two documents that share
``MIN_WORDS = ANCHOR + GRAMS - 1`` words share an anchor inside them. Only the suffixes that begin
with an anchor are kept, about one in ten. A suffix reaches ``REACH`` words beyond its anchor and
is extended as many to the left: farther on, a shared passage meets the next shared anchor.

1. Texts that are equal collapse to the smallest id; the others are repeated as wholes.
2. Suffixes that are equal as far as they reach, on both sides, collapse to the first place; the
   others are repeated as far as that.
3. The suffixes left over whose anchor has several are sorted by (anchor, words to the right).
   Neighbours are compared: the suffixes with ``r`` common words after the anchor are an interval
   of this order, bounded by common prefixes shorter than that.
4. Matches are extended to the left by a second order, by (anchor, words to the left, outward),
   and its common prefixes. Two suffixes in one interval of ``r`` words to the right and in one of
   ``REACH - r`` to the left share ``MIN_WORDS`` words. Of each such group the first place stays
   and the others are repeated. All ``r`` are tried, so no match depends on which suffixes happen
   to be next to each other.
5. The marked pieces of a document that overlap make one span.

The suffixes of an anchor are sorted in one task, as long as they are ``MOST`` at most. Those of a
more frequent anchor are dealt by the digests of their ``MIN_WORDS`` words, which gives the groups
of step 4 directly. Texts are read twice and not shuffled, but for the documents of step 3, which
meet their anchors by id; all else moves hashes and positions. What is gathered in one place
belongs to one document or is ``MOST`` suffixes.

Defined results: a null, empty or blank text has no words. Repeated rows of an id and text are
one document. Null ids rank first among equal texts and are left out elsewhere. Ties go to the
smaller (id, position). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, ship_package
from textmatch.llm.common import (
    WordHashes,
    join_groups,
    mix64,
    place,
    place_at,
    place_id,
    rows_with,
    run_hashes,
    table,
    utf8,
)

MIN_WORDS = 50
ANCHOR = 32
GRAMS = MIN_WORDS - ANCHOR + 1
REACH = GRAMS - 1
MOST = 4096  # suffixes of an anchor that are sorted in one task
BLOCK = 64  # texts taken at a time
CHUNK = 16_384  # sorted suffixes compared at a time, or the few more that end an anchor

_hashes: list[WordHashes] = []


def word_hashes(text: bytes | None) -> np.ndarray:
    if not _hashes:
        _hashes.append(WordHashes())
    return _hashes[0].of(text.lower().split() if text else [])


def _least(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``MIN_WORDS`` words the place of its anchor, and the keys of all runs."""
    keys = run_hashes(words, ANCHOR)
    if len(words) < MIN_WORDS:
        return np.empty(0, np.int64), keys
    order = mix64(keys ^ np.uint64(0xA24BAED4963EE407))
    windows = np.lib.stride_tricks.sliding_window_view(order, GRAMS)
    # The rightmost of equal ones, so that a repeating text keeps few.
    return GRAMS - 1 - np.argmin(windows[:, ::-1], axis=1) + np.arange(len(windows)), keys


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the anchors of a document with at least ``MIN_WORDS`` words."""
    least, keys = _least(words)
    at = np.unique(least)
    return at, keys[at]


def _sums(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words of each range, the same wherever the range is."""
    sums = np.zeros(len(words) + 1, np.uint64)
    power = np.cumprod(np.full(len(words) + 1, 0x9E3779B97F4A7C15, np.uint64))
    np.cumsum(mix64(words) * power[:-1], out=sums[1:])
    # The sum of word * power[i], brought to a common power.
    return (sums[high] - sums[low]) * power[len(words) - low] * _inverse(len(words))


def _contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the words around each anchor, and of how far they reach."""
    low = np.maximum(at - REACH, 0)
    high = np.minimum(at + ANCHOR + REACH, len(words))
    shape = ((at - low) * 1000 + (high - at)).astype(np.uint64)
    return mix64(_sums(words, low, high) + shape * np.uint64(0xD6E8FEB86659FD93))


def _inverse(n: int) -> np.uint64:
    """The inverse of the multiplier to the power ``n``: sums no longer depend on the length."""
    return np.uint64(pow(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n, 1 << 64))


_LONGS = T.ArrayType(T.LongType())
_LIST = pa.list_(pa.int64())


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, n_words, at[], key[], context[]) per document."""
    from xxhash import xxh3_128_digest

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        made = [[], [], [], [], []]
        for text in utf8(columns[0]):
            words = word_hashes(text)
            at, keys = anchors(words)
            around = _contexts(words, at) if len(at) else keys
            row = (
                xxh3_128_digest(words.tobytes()) if len(words) else None, len(words),
                at, keys.view(np.int64), around.view(np.int64),
            )
            for column, value in zip(made, row):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), _LIST, _LIST, _LIST]
        return [pa.array(column, kind) for column, kind in zip(made, kinds)]

    fields = [
        T.StructField("content", T.BinaryType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("at", _LONGS),
        T.StructField("key", _LONGS),
        T.StructField("context", _LONGS),
    ]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    return rows_with(rows, ["body"], fields, run, carry=["id"])


def _suffixes(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, key, n, right, left): the ``wanted`` (id, at, key, n) anchors with the hashes of
    the words around them, big-endian, outward from the anchor."""
    mine = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "key", "n")).alias("asked"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    rows = rows.join(mine, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                part = whole.slice(start, BLOCK)
                asked = part.column("asked")
                starts = asked.offsets.to_numpy()
                places, wants, sizes = (asked.values.field(n).to_numpy() for n in ("at", "key", "n"))
                out: list[list] = [[] for _ in range(6)]
                for i, (doc, text) in enumerate(zip(part.column("id").to_pylist(), utf8(part.column("body")))):
                    words = word_hashes(text)
                    keys = run_hashes(words, ANCHOR).view(np.int64)
                    forward = words.astype(">u8").tobytes()
                    back = words[::-1].astype(">u8").tobytes()
                    for at, key, n in zip(*(x[starts[i] : starts[i + 1]].tolist() for x in (places, wants, sizes))):
                        # An anchor that isn't here is that of another row of the same id.
                        if at < len(keys) and keys[at] == key:
                            right, left = 8 * (at + ANCHOR), 8 * (len(words) - at)
                            row = (doc, at, key, n, forward[right : right + 8 * REACH], back[left : left + 8 * REACH])
                            for column, value in zip(out, row):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.binary()] * 2)],
                    names=["id", "at", "key", "n", "right", "left"],
                )

    return rows.mapInArrow(run, "id bigint, at bigint, key bigint, n bigint, right binary, left binary")


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of one side, zeros behind the last, and how many there are."""
    values = column.to_pylist()
    words = np.frombuffer(b"".join(x.ljust(8 * REACH, b"\0") for x in values), ">u8").reshape(-1, REACH)
    return words, np.fromiter((len(x) // 8 for x in values), np.int64, len(values))


def _common(keys: np.ndarray, words: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By row, how many words it shares with the one before it in ``order``; -1 at a new anchor."""
    a, b = order[:-1], order[1:]
    same = words[a] == words[b]
    same &= np.arange(REACH) < np.minimum(sizes[a], sizes[b])[:, None]
    shared = np.full(len(keys), -1)
    shared[b] = np.where(keys[a] == keys[b], np.cumprod(same, axis=1).sum(axis=1), -1)
    return shared


def matches(ids: np.ndarray, at: np.ndarray, keys: np.ndarray, right: pa.Array, left: pa.Array):
    """(row, first row, least r, greatest r) of the repeated stretches among sorted suffixes.

    The rows come sorted by (anchor, words to the right), each anchor complete. A stretch goes
    from ``REACH - least r`` words before the anchor to ``greatest r`` words after it.
    """
    n = len(ids)
    place = np.empty(n, np.int64)
    place[np.lexsort((at, ids))] = np.arange(n)
    ahead, ahead_size = _side(right)
    back, back_size = _side(left)
    rows = np.arange(n)
    text = np.concatenate([keys.astype(">i8")[:, None].view(">u8"), back], axis=1)
    by_left = np.argsort(np.ascontiguousarray(text).view(f"S{8 * (REACH + 1)}").ravel(), kind="stable")
    # Equal keys are together in both orders.
    after = _common(keys, ahead, ahead_size, rows)
    before = _common(keys, back, back_size, by_left)
    first = np.full((n, REACH + 1), -1)
    for r in range(REACH + 1):
        interval = np.cumsum(after < r)
        extended = np.empty(n, np.int64)
        extended[by_left] = np.cumsum(before[by_left] < REACH - r)
        whole = np.flatnonzero((ahead_size >= r) & (back_size >= REACH - r))
        group = interval[whole] * (n + 1) + extended[whole]
        order = np.lexsort((place[whole], group))
        group, whole = group[order], whole[order]
        begins = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        head = whole[np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))]
        first[whole[~begins], r] = head[~begins]
    fresh = np.ones_like(first, bool)
    fresh[:, 1:] = first[:, 1:] != first[:, :-1]
    last = np.ones_like(first, bool)
    last[:, :-1] = fresh[:, 1:]
    row, low = np.nonzero(fresh & (first >= 0))
    high = np.nonzero(last & (first >= 0))[1]
    return row, first[row, low], low, high


def _sorted_matches(suffixes: DataFrame) -> DataFrame:
    """(id, start, end, first_id, shift) of anchors with at most ``MOST`` suffixes."""
    names = ["id", "at", "key", "right", "left"]

    def found(part: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        ids, at, keys = (part.column(c).to_numpy() for c in names[:3])
        sides = (part.column(c).combine_chunks() for c in names[3:])
        row, head, low, high = matches(ids, at, keys, *sides)
        columns = [ids[row], at[row] - (REACH - low), at[row] + ANCHOR + high, ids[head], at[head] - at[row]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["id", "start", "end", "first_id", "shift"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            part = pa.Table.from_batches(held)
            keys = part.column("key").to_numpy()
            # The last anchor may go on.
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield found(part.slice(0, cut))
            held, rows = part.slice(cut).to_batches(), part.num_rows - cut
        if rows:
            yield found(pa.Table.from_batches(held))

    dealt = suffixes.select(*names).repartition("key").sortWithinPartitions("key", "right", "left")
    return dealt.mapInArrow(run, "id bigint, start bigint, end bigint, first_id bigint, shift bigint")


def _dealt_matches(suffixes: DataFrame) -> DataFrame:
    """The same for anchors of any frequency, by digests of the words of each stretch."""
    r = F.col("r")
    reach = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("r")
    each = suffixes.select("id", "at", "key", "right", "left", reach)
    each = each.where((F.octet_length("right") >= 8 * r) & (F.octet_length("left") >= 8 * (REACH - r)))
    words = F.concat(F.substring("right", F.lit(1), 8 * r), F.substring("left", F.lit(1), 8 * (REACH - r)))
    each = materialize(each.select("id", "at", "key", "r", F.md5(words).alias("words")), "stretches")
    keys = ["key", "r", "words"]
    groups = each.groupBy(*keys).agg(F.min(place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(*keys, "n", place_id("first").alias("first_id"), place_at("first").alias("first_at"))
    again = join_groups(each, materialize(groups, "repeated"), keys, each.count())
    return again.where((F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at"))).select(
        "id", (F.col("at") - (REACH - r)).alias("start"), (F.col("at") + ANCHOR + r).alias("end"),
        "first_id", (F.col("first_at") - F.col("at")).alias("shift"),
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, first_id): spans of words that an earlier place has too."""
    ship_package(docs.sparkSession)
    scanned = materialize(_scan(docs, id_col, text_col), "scanned")
    texts = scanned.where("content IS NOT NULL")
    rows = texts.count()
    first = materialize(
        texts.groupBy("content").agg(F.min("id").alias("first"), F.count("*").alias("n")), "texts"
    )
    copies = (
        join_groups(texts.select("id", "content", "n_words"), first.where("n > 1"), ["content"], rows)
        .where((F.col("id") != F.col("first")) & (F.col("n_words") >= MIN_WORDS))
        .select("id", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"),
                F.col("first").alias("first_id"), F.lit(0).cast("bigint").alias("shift"))
    )
    own = texts.join(first.select("content", F.col("first").alias("id")), ["content", "id"], "left_semi")
    suffixes = own.select("id", "n_words", F.arrays_zip("at", "key", "context").alias("z")).select(
        "id", "n_words", F.inline("z")
    )
    contexts = suffixes.groupBy("key", "context").agg(
        F.min(place()).alias("first"), F.count("*").alias("n")
    )
    first = F.struct(place_id("first").alias("id"), place_at("first").alias("at"))
    contexts = materialize(contexts.withColumn("first", first), "contexts")
    twice = contexts.where("n > 1")
    total = contexts.agg(F.sum("n")).first()[0] or 0
    low = F.greatest(F.col("at") - REACH, F.lit(0))
    high = F.least(F.col("at") + ANCHOR + REACH, F.col("n_words"))
    same = (
        join_groups(suffixes, twice, ["key", "context"], total)
        .where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
        .select("id", low.alias("start"), high.alias("end"), F.col("first.id").alias("first_id"),
                (F.col("first.at") - F.col("at")).alias("shift"))
        .where(F.col("end") - F.col("start") >= MIN_WORDS)
    )
    several = contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    several = materialize(several, "several")
    each = join_groups(contexts.select("key", "first.*"), several.withColumn("m", F.col("n")), ["key"], contexts.count())
    wanted = each.select("id", "at", "key", F.col("m").alias("n"))
    kept = materialize(_suffixes(docs, wanted, id_col, text_col), "suffixes")
    again = _sorted_matches(kept.where(F.col("n") <= MOST)).union(_dealt_matches(kept.where(F.col("n") > MOST)))
    return _joined(copies.union(same).union(again))


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of a document that overlap or touch make one span; its source is that of the
    longest passage from one place, and the smallest among those."""
    mine = pieces.groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "first_id", "shift"))).alias("pieces")
    )

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for row in columns[0].to_pylist():
            spans: list[dict] = []
            since: dict[tuple, list[int]] = {}  # the passage that goes on, by its source
            for p in row:
                passage = since.setdefault((p["first_id"], p["shift"]), [p["start"], p["end"]])
                if p["start"] > passage[1]:
                    passage[:] = p["start"], p["end"]
                passage[1] = max(passage[1], p["end"])
                best = (passage[1] - passage[0], -p["first_id"])
                if spans and p["start"] <= spans[-1]["end_word"]:
                    span = spans[-1]
                    span["end_word"] = max(span["end_word"], p["end"])
                    span["best"] = max(span["best"], best)
                else:
                    spans.append({"start_word": p["start"], "end_word": p["end"], "best": best})
            for span in spans:
                span["first_id"] = -span.pop("best")[1]
            out.append(spans)
        names = ("start_word", "end_word", "first_id")
        return [pa.array(out, pa.list_(pa.struct([(n, pa.int64()) for n in names])))]

    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("start_word", "end_word", "first_id")])
    spans = rows_with(mine, ["pieces"], [T.StructField("spans", T.ArrayType(kind))], run, carry=["id"])
    return spans.select("id", F.inline("spans"))


def op10_suffix_array(spark, sf_dir):
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "start_word", "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("first_id").alias("first_doc_id"),
    )
