"""Hard-negative mining by slots: the rows of another label that come close to a positive.

An anchor's positives are its best rows of the same label. A negative of a positive has a score
of ``low`` to ``high`` percent of the positive's. The windows of an anchor's positives overlap;
they are answered together:

1. Positives: in each cell an anchor meets the rows of its label only; the best of all cells
   are merged.
2. The upper ends of the windows, highest first, cut the scores below the first of them into
   disjoint slots. Every row of another label lies in one slot at most; a cell keeps the best
   ``negatives`` rows of each slot, and so does the merge of the cells.
3. A window takes its own slot and all below. Its best rows are the best of that suffix of
   slots, as far as its lower end allows: one sorted list of at most ``positives x negatives``
   rows per anchor serves all its windows.

Anchors are compared with all rows in bounded cells (``operators/cells.py``): neither side is
gathered or broadcast, and a cell gives at most ``positives x negatives`` rows per anchor, not
its pairs. Scores are inner products of whole numbers ``floor(scale * x)``, exact in floating
point, so no split of the work changes a result.

Defined results: rows without an id, label or vector, with a null or non-finite component, or
with one so large that scores would not be exact (``limit``: 46,340 for 64 components) take no
part. Vectors of different lengths don't meet. Ties go by id. Rows that repeat an id are rows of
their own; as an anchor, the one with the smallest label and vector counts, and no row of the
anchor's id is its positive. A negative positive score has an empty window. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize
from textmatch.llm.common import table
from textmatch.operators.cells import in_cells

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SCALE = 256
CELL_NUMBERS = 4 << 20  # components of the rows, or of the anchors, in a cell
_SCORES = 1 << 21  # scores held at once


def limit(size: Column) -> Column:
    """Components, times the scale, must be smaller: then a score fits in a double exactly."""
    return F.floor(F.sqrt(F.lit(float(1 << 53)) / size))


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows of (id, label, vec) that take part."""
    bound = limit(F.size("vec")) / scale
    fits = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < bound))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & fits)


def _matrices(rows: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: places in the table and the scaled vectors."""
    vectors = rows.column("vec").combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        part = vectors if len(at) == len(sizes) else vectors.take(pa.array(at))
        flat = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[int(size)] = at, np.floor(scale * flat).reshape(len(at), size)
    return out


def _codes(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The same small numbers for the same values on both sides."""
    both = pa.chunked_array([*a.column(name).chunks, *b.column(name).chunks]).combine_chunks()
    codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: a.num_rows], codes[a.num_rows :]


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, the earlier first among equals."""
    n = len(scores)
    if n > k:
        least = np.partition(scores, n - k)[n - k]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
        at.sort()
    else:
        at = np.arange(n)
    return at[np.argsort(-scores[at], kind="stable")]


def _by_id(items: pa.Table) -> pa.Table:
    return items.sort_by("id")


def _positives_in_cell(k: int, scale: int):
    def cell(anchors: pa.Table, items: pa.Table) -> pa.Table:
        items = _by_id(items)
        own, labels = _codes(anchors, items, "label")
        same_a, same_b = _codes(anchors, items, "id")
        there = _matrices(items, scale)
        out_a, out_b, out_s = [], [], []
        for size, (at, q) in _matrices(anchors, scale).items():
            if size not in there:
                continue
            place, x = there[size]
            for label in np.unique(own[at]):
                mine = np.flatnonzero(labels[place] == label)
                asked = np.flatnonzero(own[at] == label)
                if not len(mine):
                    continue
                rows, step = x[mine].T, max(1, _SCORES // len(mine))
                for start in range(0, len(asked), step):
                    some = asked[start : start + step]
                    for i, scores in zip(some, q[some] @ rows):
                        # The anchor's own rows aren't its positives; no score is that low.
                        scores[same_b[place[mine]] == same_a[at[i]]] = -np.inf
                        best = best_of(scores, k)
                        best = best[scores[best] > -np.inf]
                        out_a.append(np.full(len(best), at[i]))
                        out_b.append(place[mine[best]])
                        out_s.append(scores[best])
        return _rows(anchors, items, out_a, out_b, out_s)

    return cell


def _negatives_in_cell(k: int, scale: int):
    def cell(anchors: pa.Table, items: pa.Table) -> pa.Table:
        items = _by_id(items)
        own, labels = _codes(anchors, items, "label")
        there = _matrices(items, scale)
        highs, lows = (anchors.column(c).to_pylist() for c in ("highs", "lows"))
        out_a, out_b, out_s, out_slot = [], [], [], []
        for size, (at, q) in _matrices(anchors, scale).items():
            if size not in there:
                continue
            place, x = there[size]
            step = max(1, _SCORES // len(place))
            for start in range(0, len(at), step):
                for i, scores in zip(at[start : start + step], q[start : start + step] @ x.T):
                    rising = np.array(highs[i][::-1], np.float64)
                    fits = (scores <= rising[-1]) & (scores >= min(lows[i])) & (labels[place] != own[i])
                    near = np.flatnonzero(fits)
                    slots = len(rising) - np.searchsorted(rising, scores[near], "left")
                    for slot in range(1, len(rising) + 1):
                        mine = near[slots == slot]
                        best = mine[best_of(scores[mine], k)]
                        out_a.append(np.full(len(best), i))
                        out_b.append(place[best])
                        out_s.append(scores[best])
                        out_slot.append(np.full(len(best), slot, np.int32))
        found = _rows(anchors, items, out_a, out_b, out_s)
        return found.append_column("slot", pa.array(np.concatenate([np.empty(0, np.int32), *out_slot])))

    return cell


def _rows(anchors: pa.Table, items: pa.Table, a: list, b: list, scores: list) -> pa.Table:
    def one(parts: list) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)

    return pa.table(
        {
            "anchor_id": anchors.column("id").take(pa.array(one(a))),
            "other_id": items.column("id").take(pa.array(one(b))),
            "score": pa.array(one(scores)),
        }
    )


def _percent(score: Column, percent: int) -> Column:
    """The floor of so many percent of a whole score, in whole numbers."""
    hundred = F.lit(100).cast("bigint")
    part = score * F.lit(percent).cast("bigint")
    return F.call_function("div", part - F.pmod(part, hundred), hundred)


def hard_negatives(
    anchors: DataFrame,
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` and ``vectors`` have the same columns; ``low`` and ``high`` are percentages.
    """

    def columns(df: DataFrame) -> DataFrame:
        names = {"id": id_col, "label": label_col, "vec": vec_col}
        return usable(df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()]), scale)

    items = columns(vectors)
    one = F.min(F.struct("label", "vec")).alias("row")
    asked = columns(anchors).groupBy("id").agg(one).select("id", "row.label", "row.vec")
    asked = materialize(asked, "anchors")
    n_asked, n_items = asked.count(), vectors.count()
    widest = asked.agg(F.max(F.size("vec"))).first()[0] or 1
    size = max(1, CELL_NUMBERS // widest)
    kind = items.schema["id"].dataType
    pair = [T.StructField("anchor_id", kind), T.StructField("other_id", kind), T.StructField("score", T.LongType())]
    bounds = dict(n_queries=n_asked, n_items=n_items, query_rows=size, item_rows=size, query_key="id")
    order = [F.desc("score"), "other_id"]

    found = in_cells(asked, items, _positives_in_cell(positives, scale), T.StructType(pair), **bounds)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    score = F.col("score")
    # The low end is rounded up.
    found = found.withColumns({"high": _percent(score, high), "low": -_percent(-score, low)})
    found = materialize(found, "positives")

    windows = found.where("low <= high").groupBy("anchor_id")
    windows = windows.agg(F.array_sort(F.collect_list(F.struct("place", "high", "low"))).alias("w"))
    windows = windows.select("anchor_id", F.col("w.high").alias("highs"), F.col("w.low").alias("lows"))
    ready = materialize(asked.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "windows")
    slots = T.StructType([*pair, T.StructField("slot", T.IntegerType())])
    near = in_cells(ready, items, _negatives_in_cell(negatives, scale), slots, **bounds)
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(*order))
    near = near.withColumn("place", place).where(F.col("place") <= negatives)
    # Slots fall with their scores, so this order is theirs too.
    falling = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "other_id", "slot")))
    near = near.groupBy("anchor_id").agg(falling.alias("near"))

    slot = F.row_number().over(Window.partitionBy("anchor_id").orderBy("place"))
    asking = found.where("low <= high").withColumn("slot", slot)
    suffix = F.filter("near", lambda n: (n["slot"] >= F.col("slot")) & (-n["minus"] >= F.col("low")))
    return asking.join(near, "anchor_id").select(
        "anchor_id",
        F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "n"),
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"),
        F.col("n.other_id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score"),
    )


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows.where(F.pmod("vec_id", F.lit(50)) == 0), rows)


# Every anchor with every row, then two rankings.
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pair AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    list_sum([a.v[i] * r.v[i] for i in range(1, len(a.v) + 1)])::BIGINT AS score
  FROM kept a, kept r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT * FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id,
    p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positive p JOIN pair n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {NEGATIVES}
"""
