"""Exact top-k by cosine or inner product, for dense and sparse vectors.

A few queries, one block of ``BLOCK_*`` rows and cells at most, are broadcast: the corpus stays
where it is, each task multiplies its Arrow batches with the queries and keeps the best ``k`` per
query, so what is shuffled is ``k`` rows per query and task, never a row per pair. More queries
than that never come to the driver: queries and corpus meet in bounded cells
(:mod:`textmatch.operators.cells`), and each cell gives ``k`` rows per query. The plan has the
same size for any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, ship_package, small_batches
from textmatch.operators.cells import in_cells

# Queries, and numbers or terms of their vectors, that are broadcast.
BLOCK_QUERIES = 2048
BLOCK_CELLS = 16 << 20
# Queries, and corpus rows, in a cell; and numbers or terms of each side.
CELL_ROWS = 16_384
CELL_CELLS = 8 << 20
# Pairs in a cell when all of them are wanted.
CELL_PAIRS = 1 << 20
# Score cells of one step (queries x corpus rows), its queries, and the numbers of its rows or terms that
# they share with the queries, at most; about what a core's cache holds.
_CELLS = 1 << 18
_ACROSS = 4096
_NUMBERS = 1 << 20
# A term that this share of the pairs have in common is multiplied for all pairs, and such terms of a
# cell hold so many numbers at most; the other terms are looked up in the queries that hold them.
_COMMON = 0.006
_COMMON_CELLS = 6 << 20
# Corpus rows by which common terms are told.
_JUDGED = 1024


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _list_rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; a zero vector stays one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class _Dense:
    """Cosine against a block of dense queries; a zero vector scores 0."""

    def __init__(self, vectors: pa.Array):
        self.q = unit_rows(vectors)
        self.n = len(self.q)

    def prepare(self, vectors: pa.Array) -> None:
        """Nothing depends on the corpus."""

    def scores(self, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Scores against some queries at a time, with the place of the first."""
        rows = unit_rows(vectors)
        for lo in range(0, self.n, _ACROSS):
            yield lo, rows @ self.q[lo : lo + _ACROSS].T


class _Sparse:
    """Inner product (or cosine) against a block of sparse queries.

    Terms that many pairs have in common are columns of matrices, which are multiplied; the
    others are held by term. Which ones are common is judged by some rows; the scores are the
    same, but for the order of summing.
    """

    def __init__(self, vectors: pa.Array, cosine: bool):
        rows, flat = _list_rows(vectors)
        self.n = len(vectors)
        term = pc.struct_field(flat, "term")
        weight = pc.struct_field(flat, "weight").to_numpy(zero_copy_only=False)
        self.cosine = cosine
        if cosine:
            weight = self._scaled(rows, weight, self.n)
        self.terms = pc.unique(term)
        pos = pc.index_in(term, self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.held = rows, pos, weight
        self.place: np.ndarray | None = None

    @staticmethod
    def _scaled(rows: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(rows, weight * weight, n))[rows]
        return np.divide(weight, length, out=np.zeros(len(weight)), where=length > 0)

    def prepare(self, vectors: pa.Array) -> None:
        """Part the queries into blocks and their terms into common and other ones, by some of
        the corpus rows to come; once."""
        if self.place is not None:
            return
        some = vectors.take(pa.array(np.arange(0, len(vectors), max(1, len(vectors) // _JUDGED))))
        seen = pc.index_in(pc.struct_field(_list_rows(some)[1], "term"), self.terms).drop_null().to_numpy()
        rows, pos, weight = self.held
        size = len(self.terms)
        shared = np.bincount(pos, minlength=size) / max(self.n, 1)
        shared = shared * np.bincount(seen, minlength=size) / max(len(some), 1)
        most = max(1, _COMMON_CELLS // max(self.n, 1))
        common = np.argsort(-shared, kind="stable")[:most]
        common = common[shared[common] >= _COMMON]
        self.place = np.full(size, -1, np.int64)
        self.place[common] = np.arange(len(common))
        self.width = len(common)
        self.matrix = np.zeros((self.width, self.n))
        at = self.place[pos]
        self.matrix[at[at >= 0], rows[at >= 0]] = weight[at >= 0]
        rows, pos, weight = rows[at < 0], pos[at < 0], weight[at < 0]
        self.blocks = []
        for lo in range(0, self.n, _ACROSS):
            low, high = np.searchsorted(rows, [lo, lo + _ACROSS])
            order = low + np.argsort(pos[low:high], kind="stable")
            fan = np.bincount(pos[low:high], minlength=size)
            start = np.concatenate([[0], np.cumsum(fan)[:-1]]).astype(np.int64)
            self.blocks.append((lo, min(_ACROSS, self.n - lo), fan, start, rows[order] - lo, weight[order]))
        self.held = None

    def scores(self, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Scores against some queries at a time, with the place of the first."""
        rows, flat = _list_rows(vectors)
        n = len(vectors)
        weight = pc.struct_field(flat, "weight").to_numpy(zero_copy_only=False)
        if self.cosine:
            weight = self._scaled(rows, weight, n)
        pos = pc.fill_null(pc.index_in(pc.struct_field(flat, "term"), self.terms), -1)
        pos = pos.to_numpy(zero_copy_only=False)
        known = pos >= 0
        rows, weight, pos = rows[known], weight[known], pos[known].astype(np.int64)
        at = self.place[pos]
        common = at >= 0
        matrix = np.zeros((n, self.width))
        matrix[rows[common], at[common]] = weight[common]
        rows, weight, pos = rows[~common], weight[~common], pos[~common]
        for lo, wide, fan, start, asked, asked_weight in self.blocks:
            out = matrix @ self.matrix[:, lo : lo + wide]
            flat = out.reshape(-1)
            # Each known term meets the queries holding it; expanded in bounded slices.
            met = np.flatnonzero(fan[pos])
            many = fan[pos[met]]
            ends = np.cumsum(many)
            first = 0
            while first < len(met):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + _NUMBERS, "right")))
                some, f = met[first:last], many[first:last]
                held = np.repeat(start[pos[some]] - (ends[first:last] - f - base), f)
                held += np.arange(len(held))
                cell = np.repeat(rows[some] * wide, f)
                cell += asked[held]
                value = np.repeat(weight[some], f)
                value *= asked_weight[held]
                flat += np.bincount(cell, value, len(flat))
                first = last
            yield lo, out


def _scorer(kind: str, vectors: pa.Array):
    if kind == "dense":
        return _Dense(vectors)
    return _Sparse(vectors, cosine=kind == "sparse_cosine")


def _codes(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _keys(scores: np.ndarray) -> np.ndarray:
    """What scores are ranked by: six places."""
    return np.floor(scores * 1e6 + 0.5)


class _Best:
    """Running best ``k`` per query, by score to six places, then id.

    With ``ascending``, each row offered has a larger id than those before; then one that only
    equals the last of ``k`` held isn't among the best.
    """

    def __init__(self, n_queries: int, k: int, ascending: bool = False):
        self.k, self.n, self.ascending = k, n_queries, ascending
        # Per query, the key a row must reach (or pass) once k better ones are held.
        self.floor = np.full(n_queries, -np.inf)
        self.settled = False
        self.query: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.score: list[np.ndarray] = []
        self.held = 0

    def offer(self, ids: pa.Array, scores: np.ndarray, lo: int = 0) -> None:
        """Scores of a few corpus rows, in the order of their ids, against the queries from ``lo`` on."""
        floor = self.floor[lo : lo + scores.shape[1]]
        row, query = np.nonzero(self._candidates(scores, floor))
        score = scores[row, query]
        # The bar below is a little low.
        key = _keys(score)
        good = key > floor[query] if self.ascending else key >= floor[query]
        row, query, score = row[good], query[good], score[good]
        self.query.append(query + lo)
        self.ids.append(ids.take(pa.array(row)))
        self.score.append(score)
        self.held += len(query)

    def _candidates(self, scores: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which cells can still be among the best; a few more are let through."""
        k = self.k
        bar = (floor + (0.5 if self.ascending else -0.5)) / 1e6
        keep = scores >= bar - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(bar), bar, 0.0)))
        if np.count_nonzero(keep) <= 2 * k * len(floor):
            return keep
        many = np.flatnonzero(np.count_nonzero(keep, axis=0) > k)
        key = _keys(scores[:, many])
        kth = np.partition(key, len(key) - k, axis=0)[len(key) - k]
        above = key > kth
        level = key == kth
        room = k - above.sum(axis=0)
        keep[:, many] &= above | (level & (np.cumsum(level, axis=0) <= room))
        return keep

    def rest(self) -> None:
        """To be called between steps: drops what is no longer among the best, now and then."""
        if not self.settled or self.held > 3 * self.k * self.n + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Reduce what is held to the best ``k`` per query."""
        query = np.concatenate(self.query)
        ids = pa.concat_arrays(self.ids)
        score = np.concatenate(self.score)
        order = self._order(query, ids, _keys(score))
        sorted_query = query[order]
        first = np.searchsorted(sorted_query, sorted_query, "left")
        order = order[np.arange(len(order)) - first < self.k]
        out = query[order], ids.take(pa.array(order)), score[order]
        self.floor = np.full(self.n, -np.inf)
        full = np.flatnonzero(np.bincount(out[0], minlength=self.n) == self.k)
        last = np.searchsorted(out[0], full, "right") - 1
        self.floor[full] = _keys(out[2][last])
        self.query, self.ids, self.score = [out[0]], [out[1]], [out[2]]
        self.held = len(out[0])
        self.settled = True
        return out

    def _order(self, query: np.ndarray, ids: pa.Array, key: np.ndarray) -> np.ndarray:
        """By query, key and id."""
        by_id = None if self.ascending else np.argsort(_codes(ids), kind="stable")
        if len(key):
            top, n = key.max(), len(key)
            span = top - key.min() + 1
            # All in one number each, where they fit: sorting these takes much less time.
            if span * self.n * n < 2.0**62:
                one = query * int(span) + (top - key).astype(np.int64)
                one = (one if by_id is None else one[by_id]) * n + np.arange(n)
                one.sort()
                return one % n if by_id is None else by_id[one % n]
        last = np.arange(len(key)) if by_id is None else np.argsort(by_id)
        return np.lexsort((last, -key, query))


def _steps(scorer, ids: pa.Array, vectors: pa.Array, order: np.ndarray | None = None):
    """(ids, scores by blocks of queries) of a few rows at a time, in the order of their ids;
    rows without a vector are left out. ``order`` sorts all rows; otherwise each step is sorted."""
    scorer.prepare(vectors)
    wide = len(vectors.flatten()) // max(len(vectors), 1)
    step = max(1, min(_CELLS // max(min(scorer.n, _ACROSS), 1), _NUMBERS // max(wide, 1)))
    for lo in range(0, len(ids), step):
        some = np.arange(lo, min(lo + step, len(ids))) if order is None else order[lo : lo + step]
        if vectors.null_count:
            some = some[vectors.is_valid().to_numpy(zero_copy_only=False)[some]]
        if order is None:
            some = some[np.argsort(_codes(ids.take(pa.array(some))), kind="stable")]
        if len(some):
            some = pa.array(some)
            yield ids.take(some), scorer.scores(vectors.take(some))


def _feed(best: _Best, scorer, ids: pa.Array, vectors: pa.Array, order: np.ndarray | None = None) -> None:
    for some, blocks in _steps(scorer, ids, vectors, order):
        for lo, scores in blocks:
            best.offer(some, scores, lo)
        best.rest()


def _result(best: _Best, query_ids: pa.Array) -> dict[str, pa.Array]:
    query, ids, score = best.settle()
    return {
        "query_id": query_ids.take(pa.array(query)),
        "id": ids,
        "score": pa.array(score, pa.float64()),
    }


def best_in_table(queries: pa.Table, items: pa.Table, k: int, kind: str = "dense") -> pa.Table:
    """(query_id, id, score): the best ``k`` of (id, vector) for each (query_id, vector)."""
    query_ids, ids = _column(queries, "query_id"), _column(items, "id")
    best = _Best(len(query_ids), k, ascending=True)
    order = pc.sort_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    # Places in that order stand for the ids.
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    scorer = _scorer(kind, _column(queries, "vector"))
    _feed(best, scorer, pa.array(places), _column(items, "vector"), order)
    if not best.held:
        return pa.table({"query_id": query_ids.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
    found = _result(best, query_ids)
    return pa.table({**found, "id": ids.take(pa.array(order[found["id"].to_numpy()]))})


def merge_best(partial: DataFrame, k: int) -> DataFrame:
    """Merge the tasks' candidates; the rank filter becomes a group limit per task."""
    best = Window.partitionBy("query_id").orderBy(
        F.desc(F.floor(F.col("score") * 1000000 + 0.5)), "id"
    )
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    kind: str = "dense",
    block: int | None = None,
) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` corpus rows most like each query.

    ``queries`` is ``(query_id, vector)`` and ``corpus`` is ``(id, vector)``. ``kind`` is
    ``dense`` (cosine of number arrays), ``sparse`` or ``sparse_cosine`` (arrays of
    ``struct<term, weight>``). Rows are ranked by score to six places, then by id; a
    corpus row sharing nothing with a query takes part with score 0. Rows without a vector
    take no part. ``block`` bounds the queries that are broadcast, or are in a cell.
    """
    return merge_best(_scores(queries, corpus, k, kind, block), k)


def all_scores(
    queries: DataFrame, corpus: DataFrame, kind: str = "dense", block: int | None = None
) -> DataFrame:
    """``(query_id, id, score)`` of every query and corpus row, for judging whole lists."""
    return _scores(queries, corpus, None, kind, block)


def _scores(
    queries: DataFrame, corpus: DataFrame, k: int | None, kind: str, block: int | None
) -> DataFrame:
    """The tasks' best (or all) scores."""
    if kind not in ("dense", "sparse", "sparse_cosine"):
        raise ValueError(f"unknown kind: {kind}")
    ship_package(corpus.sparkSession)
    small_batches(corpus.sparkSession)
    queries = materialize(queries.select("query_id", "vector"), "queries")
    queries = queries.where(F.col("vector").isNotNull())
    corpus = corpus.select("id", "vector")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("cells")).first()
    if size.n <= (block or BLOCK_QUERIES) and (size.cells or 0) <= BLOCK_CELLS:
        return _by_broadcast(queries.toArrow(), corpus, k, kind, schema)
    wide = max(1, size.cells // size.n)
    rows = max(1, min(CELL_ROWS, CELL_CELLS // wide))
    asked = min(block or CELL_ROWS, rows)
    if k is None:
        asked = min(asked, max(1, CELL_PAIRS // rows))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if k is not None:
            return best_in_table(a, b, k, kind)
        ids, scorer = _column(a, "query_id"), _scorer(kind, _column(a, "vector"))
        found = list(_every(scorer, ids, _column(b, "id"), _column(b, "vector")))
        return pa.Table.from_batches(found) if found else best_in_table(a, b.slice(0, 0), 1, kind)

    total = corpus.select("id").count()
    return in_cells(queries, corpus, cell, schema, size.n, total, query_rows=asked, item_rows=rows)


def _by_broadcast(
    block: pa.Table, corpus: DataFrame, k: int | None, kind: str, schema: T.StructType
) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        (_column(block, "query_id"), _column(block, "vector"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best = _Best(len(query_ids), k or 1)
        scorer = _scorer(kind, vectors) if len(query_ids) else None
        for batch in batches:
            if scorer is None or not batch.num_rows:
                continue
            ids, items = _column(batch, "id"), _column(batch, "vector")
            if k is None:
                yield from _every(scorer, query_ids, ids, items)
            else:
                _feed(best, scorer, ids, items)
        if best.held:
            yield pa.RecordBatch.from_pydict(_result(best, query_ids))

    return corpus.mapInArrow(run, schema)


def _every(scorer, query_ids: pa.Array, ids: pa.Array, vectors: pa.Array):
    for some, blocks in _steps(scorer, ids, vectors):
        for lo, scores in blocks:
            row, query = np.indices(scores.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": query_ids.take(pa.array(query + lo)),
                    "id": some.take(pa.array(row)),
                    "score": pa.array(scores.reshape(-1), pa.float64()),
                }
            )
