"""Vector codes: a product quantiser whose nearest entries come from an equal-average search.

Components become integers (``floor(scale * x)``) and a vector is cut into ``parts`` equal
pieces. Each piece has a codebook that starts as that piece of the first ``entries`` vectors by
id; each of ``rounds`` rounds assigns every piece to its nearest entry and moves each entry to
the floor of its pieces' mean. Distances are squared Euclidean, ties go to the lower index.

The nearest entry is found by sums. Entries are sorted by the sum of their components; from the
place of a piece's own sum the search goes outward, the nearer sum first, and ends when the
squared gap of the sums over the number of components exceeds the best distance: by
Cauchy-Schwarz no entry farther out can be as near. All arithmetic is in whole numbers, so any
split of the input gives the same codes.

A round is one pass over the vectors. A task adds up its own pieces; what is shuffled and comes
to the driver is at most one row of sums per part and entry and task, and then per part and
entry. The codebooks, ``entries`` vectors in size, go out with each pass. No vector is shuffled
or copied.

Defined results: rows whose vector is null or has a null or non-finite component are left out,
and so are those whose length isn't a positive multiple of ``parts`` or not that of the first
vector by id, or with a component too large for exact sums (``limit``: 8,192 for 64
components). With fewer than ``entries`` vectors the codebooks have as many entries. Null ids
come last; repeated rows count as often as they occur, and ties of ids go by the vector. An
entry that no piece is assigned to stays. An error sum too large for a long is null. An empty
table gives no rows. Other columns are carried on; one named as a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, ship_package
from textmatch.llm.common import join_groups, rows_with, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
SLICE = 4096  # vectors taken at a time


def limit(size: int, parts: int = PARTS, scale: int = SCALE) -> float:
    """Components must be smaller, so that squared sums of a part and errors fit in a long."""
    return (1 << 28) / max(1, size // parts) / scale


def _usable(vec: Column, bound: Column) -> Column:
    """Whether there is a vector, all of whose components are numbers below the bound."""
    return F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < bound))


def scaled(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).astype(np.int64).reshape(len(vectors), size)


@dataclass(frozen=True)
class Book:
    """The entries of one part, sorted by the sum of their components."""

    entries: np.ndarray  # as numbered
    order: np.ndarray
    sums: np.ndarray  # sorted

    @classmethod
    def of(cls, entries: np.ndarray) -> Book:
        sums = entries.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        return cls(entries, order, sums[order])

    def nearest(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each piece."""
        n, size = pieces.shape
        last = len(self.order)
        own = pieces.sum(axis=1)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        far = np.iinfo(np.int64).max
        best = np.full(n, far)
        index = np.full(n, last)
        going = np.arange(n)
        while len(going):
            low, high, sums = left[going], right[going], own[going]
            below = np.where(low >= 0, sums - self.sums[low], far)
            above = np.where(high < last, self.sums[np.minimum(high, last - 1)] - sums, far)
            gap = np.minimum(below, above)
            there = gap < far
            near = best[going]
            unseen = near == far
            there &= unseen | (np.where(there, gap, 0) ** 2 <= np.where(unseen, 0, near) * size)
            going, down, low, high = going[there], (below <= above)[there], low[there], high[there]
            entry = self.order[np.where(down, low, high)]
            gaps = pieces[going] - self.entries[entry]
            distance = (gaps * gaps).sum(axis=1)
            better = (distance < best[going]) | ((distance == best[going]) & (entry < index[going]))
            best[going[better]] = distance[better]
            index[going[better]] = entry[better]
            left[going[down]] -= 1
            right[going[~down]] += 1
        return index, best


class Codebooks:
    """One book per part."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        """``entries``: (parts, entries, components of a part) integers."""
        self.entries, self.scale = entries, scale
        self.parts, self.count, self.width = entries.shape
        self.size = self.parts * self.width
        self.books = [Book.of(e) for e in entries]

    def assign(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pieces, index, distance) of each part."""
        rows = scaled(vectors, self.size, self.scale).reshape(-1, self.parts, self.width)
        for p, book in enumerate(self.books):
            pieces = np.ascontiguousarray(rows[:, p])
            yield pieces, *book.nearest(pieces)

    def moved(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
        """The books whose entries are the floors of their pieces' means."""
        entries = self.entries.copy()
        for (p, e), (total, count) in sums.items():
            entries[p, e] = [x // count for x in total]
        return Codebooks(entries, self.scale)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first_books(rows: DataFrame, size: int, parts: int, entries: int, scale: int) -> Codebooks:
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
    vectors = scaled(first.column("vec").combine_chunks(), size, scale)
    pieces = vectors.reshape(len(vectors), parts, size // parts)
    return Codebooks(np.ascontiguousarray(pieces.transpose(1, 0, 2)), scale)


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[list[int], int]]:
    """By part and entry: the sums of the components assigned to it, and how many pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.entries.shape, np.int64)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                vectors = batch.column("vec").slice(start, SLICE)
                for p, (pieces, index, _) in enumerate(books.assign(vectors)):
                    count[p] += np.bincount(index, minlength=books.count)
                    order = np.argsort(index, kind="stable")
                    used, begin = np.unique(index[order], return_index=True)
                    total[p, used] += np.add.reduceat(pieces[order], begin, axis=0)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part.astype(np.int32)),
                "entry": pa.array(entry.astype(np.int32)),
                "total": pa.array(total[part, entry].tolist(), pa.list_(pa.int64())),
                "n": pa.array(count[part, entry]),
            }
        )

    found = rows.select("vec").mapInArrow(run, "part int, entry int, total array<bigint>, n bigint")
    whole = T.DecimalType(38, 0)
    places = F.posexplode("total").alias("at", "x")
    sums = (
        found.select("part", "entry", "n", places)
        .groupBy("part", "entry", "at")
        .agg(F.sum(F.col("x").cast(whole)).alias("x"), F.sum("n").alias("n"))
    )
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    for r in sums.orderBy("part", "entry", "at").collect():
        out.setdefault((r.part, r.entry), ([], r.n))[0].append(int(r.x))
    return out


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """The usable rows with ``code`` (an index per part) and ``error``, and the final codebooks."""
    ship_package(vectors.sparkSession)
    vec = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"))
    fits = (F.size("vec") > 0) & (F.size("vec") % parts == 0)
    bound = F.lit(float(1 << 28) / scale) / (F.size("vec") / parts)
    rows = rows.where(fits & _usable(F.col("vec"), bound))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).first()
    fields = [T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    if first is None:
        none = vectors.where(F.lit(False)).drop("code", "error")
        return none.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields}), None
    size = first.n
    rows = rows.where(F.size("vec") == size)
    books = _first_books(rows, size, parts, entries, scale)
    for _ in range(rounds):
        books = books.moved(_sums(rows, books))
    kept = vectors.where((F.size(vec) == size) & _usable(vec, F.lit(limit(size, parts, scale))))

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        found = [(index, distance) for _, index, distance in books.assign(columns[0])]
        code = np.stack([index for index, _ in found], axis=1).astype(np.int32)
        offsets = pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32))
        error = sum(distance for _, distance in found)
        return [pa.ListArray.from_arrays(offsets, pa.array(code.ravel())), pa.array(error)]

    return rows_with(kept, [vec_col], fields, run, slice_rows=SLICE), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors of equal labels added up, nulls together.

    A label may hold any share of the rows: sums are combined before the shuffle, and those of
    the few frequent labels are broadcast. Pass a written table; it is read twice.
    """
    label = F.col(f"`{label_col}`")
    key = {"_label": F.coalesce(label.cast("string"), F.lit("")), "_none": label.isNull()}
    rows = coded.drop("label_error").withColumns(key)
    sums = rows.groupBy(*key).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return join_groups(rows, sums, list(key), total).drop(*key)


def op11_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = compress(rows)
    coded = materialize(coded.select("vec_id", "label", "code", "error"), "coded")
    found = with_label_error(coded)
    digits = F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0")))
    return found.select(
        "vec_id",
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def _rounds_sql(rounds: int) -> str:
    """The rounds one after another, each from the codebooks of the one before."""
    near = """
a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d
  FROM (SELECT vec_id, q.p, e, list_sum([(q.v[i] - b.v[i]) * (q.v[i] - b.v[i])
          for i in range(1, len(q.v) + 1)])::HUGEINT AS d
        FROM piece q JOIN b{r} b ON q.p = b.p)
  GROUP BY vec_id, p)"""
    move = """,
b{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v
  FROM b{r} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT q.p, a.e, i, sum(q.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
          FROM piece q JOIN a{r} a ON q.vec_id = a.vec_id AND q.p = a.p,
            (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM piece))) AS i)
          GROUP BY q.p, a.e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e),"""
    return "".join(near.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + near.format(r=rounds)


# Every distance, then the least; floors of negative means go down.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
piece AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (
  SELECT p, e, v FROM piece JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})
  USING (vec_id)),{_rounds_sql(ROUNDS)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM b{ROUNDS}),
code AS (
  SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  sha AS codebooks_sha256
FROM code JOIN kept USING (vec_id), book
"""
