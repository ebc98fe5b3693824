"""Near-duplicate documents by circulant MinHash, confirmed on whole shingle sets.

A document is the set of its distinct runs of five words. Two permutations make all signature
coordinates: the first gives each shingle a place among ``2 ** 20`` (a mixing of its hash), the
second is a shuffled table of those places. Coordinate ``k`` is the least table entry over the
document's places, all shifted circularly by ``k``; as shifts are neighbours in the table, one
contiguous slice per shingle serves every coordinate. ``BANDS`` bands of ``ROWS`` coordinates
give a document its buckets: two documents at the limit of 0.75 miss each other in all of them
once in fifty thousand, and less with every further similarity.

Equal sets collapse first, by their digest. Then every member of a bucket is compared with the
bucket's first one; that settles most groups of copies with one comparison per member. A bucket
whose members aren't in one component yet is open, and each of its pairs that spans two
components is still to be compared:

* A member is left out of an open bucket if it can't be linked to any other there: its shingles
  that no other member of an open bucket has can't be shared, and a link needs
  ``percent * (n + m) / (100 + percent)`` shared ones, ``m`` being the least set in the bucket.
* Buckets left with the same members are one. A bucket is dealt into cells of two blocks of at
  most about ``BLOCK`` members, so that any two members meet in a cell, and a cell counts all overlaps
  of its sets at once, as products of incidence matrices. Only links leave it.

So every pair that shares a bucket is compared on whole sets, is shown not to be similar by a
bound, or is connected already; pairs are never rows, however large a group is.

Defined results: a null text, an empty text and one without words have an empty set, linked
with nothing. A null id is never a component; its row takes the component of an equal text, or
null, and stays if there is none. Rows that repeat an id are one node: linked if any of their
texts is. Ties go to the smaller id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize
from textmatch.llm.common import (
    WordHashes,
    join_groups,
    mix64,
    rows_with,
    run_hashes,
    table,
    utf8,
)
from textmatch.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 5
PLACES = 1 << 20
SEED = 20_231
#: members that are compared with each other in one place, and blocks of partners of one set
BLOCK, DEALT = 512, 256


@lru_cache(maxsize=1)
def _slices() -> np.ndarray:
    """Row ``p`` holds the entries of the shuffled table from place ``p`` on, circularly."""
    shuffled = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
    circle = np.concatenate([shuffled, shuffled[: BANDS * ROWS - 1]])
    return np.lib.stride_tricks.sliding_window_view(circle, BANDS * ROWS)


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII blanks only
    hashes = _word_hashes().of(words)
    return np.unique(run_hashes(hashes, min(SHINGLE, len(words)))) if words else hashes


def signature(found: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of shingle hashes."""
    places = (mix64(found ^ np.uint64(SEED)) & np.uint64(PLACES - 1)).astype(np.int64)
    slices, least = _slices(), None
    for at in range(0, len(places), 256):  # a block stays in the processor's cache
        block = slices[places[at : at + 256]].min(axis=0)
        least = block if least is None else np.minimum(least, block)
    return least


def buckets(found: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signature(found).reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest, buckets); digest and buckets are null for an empty set."""
    from xxhash import xxh3_128_digest

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        sizes, digests, keys = [], [], []
        for text in utf8(columns[0]):
            found = shingles(text)
            sizes.append(len(found))
            digests.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
            keys.append(buckets(found).view(np.int64) if len(found) else None)
        return [
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array(keys, pa.list_(pa.int64())),
        ]

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.LongType())),
    ]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    return rows_with(rows, ["body"], fields, run, carry=["id"])


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents whose id is in ``wanted``."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        found = [shingles(t).view(np.int64) for t in utf8(columns[0])]
        return [pa.array(found, pa.list_(pa.int64()))]

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("body"))
    # The ids grow with the input: the same join at every size.
    rows = rows.join(wanted.hint("merge"), "id", "left_semi")
    fields = [T.StructField("shingles", T.ArrayType(T.LongType()))]
    return rows_with(rows, ["body"], fields, run, carry=["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The partners of an ``a`` are dealt into
    up to ``DEALT`` blocks, each with a copy of its set."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(DEALT)).alias("block"))
    ours = dealt.select("a", "block").distinct().join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"
    )
    theirs = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = theirs.join(ours, ["a", "block"]).select(
        "a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total")
    )
    return both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select(
        "a", "b"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``."""
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    # One representative per set: the least id.
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("copies")
    )
    classes = materialize(classes, "classes")
    chosen = signed.join(classes.select("digest", F.col("first").alias("id")), ["digest", "id"], "left_semi")
    keyed = chosen.select(F.explode("buckets").alias("key"), "id", "n_shingles")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = materialize(keyed.join(shared.select("key"), "key"), "members")
    wanted = members.select("id").distinct()
    sets = materialize(_sets(docs, wanted, id_col, text_col), "sets")
    forest = _settle(members, sets, percent)
    found = classes.join(
        forest.select(F.col("node").alias("first"), "component"), "first", "left"
    ).select("digest", F.coalesce("component", "first").alias("component"), "copies", "first")
    # Only sets that are shared or linked say anything about another row.
    found = found.where((F.col("copies") > 1) | (F.col("component") != F.col("first")))
    found = found.select("digest", "component", F.col("copies").alias("n"))
    rows = signed.select("id", "n_shingles", "digest")
    return join_groups(rows, found, ["digest"], rows.count(), "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def _settle(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all links between members of a bucket."""
    heads = members.groupBy("key").agg(
        F.min(F.struct("id", "n_shingles")).alias("h"), F.count("*").alias("n")
    )
    n, m = F.col("n_shingles"), F.col("h.n_shingles")
    total = members.count()
    pairs = (
        join_groups(members, materialize(heads, "heads"), ["key"], total)
        .where((F.col("id") != F.col("h.id")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)))
        .select(F.col("h.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    links = _confirmed(materialize(pairs, "pairs"), sets, percent)
    forest = components(links, "a", "b")
    named = members.join(forest.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    open_ = materialize(_open(materialize(named, "named")), "open")
    within = _within(_possible(open_, sets, percent), sets, percent)
    more = within.union(forest.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(more, "a", "b")


def _open(members: DataFrame) -> DataFrame:
    """The buckets whose members are in several components; ``members`` is a written table."""
    mixed = members.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")
    )
    mixed = materialize(mixed.where("lo < hi").select("key", "n"), "mixed")
    return join_groups(members, mixed, ["key"], members.count())


def _possible(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, component) of the members that could be linked within their bucket."""
    involved = sets.join(open_.select("id").distinct(), "id", "left_semi")
    only_once = (
        involved.select("id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.min("id").alias("id"), F.max("id").alias("last"))
        .where("id = last")
        .groupBy("id")
        .agg(F.count("*").alias("alone"))
    )
    least = open_.groupBy("key").agg(F.min("n_shingles").alias("least"), F.count("*").alias("n"))
    n = F.col("n_shingles")
    partner = F.greatest(F.col("least"), F.floor(n * percent / 100))
    placed = join_groups(open_, materialize(least, "least"), ["key"], open_.count())
    able = placed.join(only_once, "id", "left").where(
        (100 + percent) * (n - F.coalesce("alone", F.lit(0))) >= percent * (n + partner)
    )
    able = materialize(able.select("key", "id", "component"), "able")
    return materialize(_open(able), "able")


def _within(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each member and each other component in its bucket, a link if there is one."""
    alike = able.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("print"),
        F.min("id").alias("lo"), F.max("id").alias("hi"),
    )
    chosen = alike.groupBy("size", "print", "lo", "hi").agg(F.min("key").alias("key"))
    chosen = materialize(chosen.select("key", "size", F.col("size").alias("n")), "chosen")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = join_groups(able, chosen, ["key"], able.count()).select(
        "key", "id", "component", blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("mine"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = dealt.select("*", other.alias("other")).select(
        "key", "id", "component",
        F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("column"),
    )
    filled = (
        cells.join(sets, "id")
        .repartition("key", "row", "column")
        .sortWithinPartitions("key", "row", "column")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        found: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "row", "column"))))
            ids = batch.column("id").to_pylist()
            named = batch.column("component").to_pylist()
            lists = batch.column("shingles")
            for i, key in enumerate(keys):
                if key != cell:
                    found += linked(held, percent)
                    cell, held = key, []
                held.append((ids[i], named[i], lists[i].values.to_numpy()))
        found += linked(held, percent)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"]
        )

    return filled.mapInArrow(run, "a bigint, b bigint")


def linked(members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between (id, component, set) of different components: at most one for each member
    and component, and none whose two ends are both in the most frequent component."""
    if len(members) < 2:
        return []
    ids, named = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    sizes = np.array([len(m[2]) for m in members])
    kinds, which, times = np.unique(named, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(which != np.argmax(times))
    owner = np.repeat(np.arange(len(members)), sizes)
    _, column, count = np.unique(
        np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True
    )
    number = np.cumsum(count > 1) - 1  # shingles of one member only need no column
    several = count[column] > 1
    owner, column = owner[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((len(rest), len(members)), np.float32)
    for low in range(0, int(number[-1]) + 1, 2048):
        part = slice(*np.searchsorted(column, [low, low + 2048]))
        dense = np.zeros((len(members), 2048), np.float32)
        dense[owner[part], column[part] - low] = 1
        overlap += dense[rest] @ dense.T
    total = sizes[rest][:, None] + sizes[None, :]
    fits = (100 * overlap >= percent * (total - overlap)) & (which[rest][:, None] != which[None, :])
    x, y = np.nonzero(fits)
    _, first = np.unique(x * len(kinds) + which[y], return_index=True)
    return list(zip(ids[rest[x[first]]].tolist(), ids[y[first]].tolist()))


def op3_minhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i
        FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b
  ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
twoway AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS other FROM twoway
  UNION SELECT reach.node, twoway.b FROM reach JOIN twoway ON reach.other = twoway.a),
lowest AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  coalesce(m, d.doc_id)::BIGINT AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest ON node = d.doc_id
"""
