"""Approximate top-k by cosine: an inverted file over the cells of fitted centres.

``build_inverted_file`` fits centres on a bounded sample, puts **every** row into the list of its
nearest centre, and finds out on a few of the rows how many lists a search has to open for the
recall that is asked for. ``search`` gives each query to that many lists, those of its nearest
centres; queries and rows meet by the number of the list in one shuffle, and the score of each
pair that meets is exact. No step compares a query with all rows, except for the bounded trial.

A list that holds many rows, or that many queries open, is cut into a grid of bounded parts, so
a hot cell is many tasks. Only the centres are broadcast; their number is bounded by
``MOST_CELLS``.

Rows and queries without a vector take no part; a zero vector scores 0. Rows that repeat an id
are rows of their own. Results are ranked as by ``top_k``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, ship_package
from textmatch.operators.similarity import best_in_table, merge_best, top_k, unit_rows

MOST_CELLS = 16_384
SAMPLE = 32  # rows for each centre that they are fitted on, at most
TRIAL = 128  # rows whose exact neighbours decide how many lists are opened
PART_ROWS = 16_384  # of a list, in one task at a time
PART_QUERIES = 8_192


@dataclass(frozen=True)
class InvertedFile:
    """``lists`` is (id, vector, cell) with every row, ``sizes`` is (cell, n)."""

    centres: np.ndarray
    lists: DataFrame
    sizes: DataFrame
    probes: int


def _by_hash(rows: DataFrame, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their ids: the same whenever they are drawn.

    Rows above twice the share wanted can't be among them and aren't sorted.
    """
    place = F.xxhash64(F.lit(n), "id")
    near = place / float(1 << 64) + 0.5 <= 2 * n / max(total, 1) + 1e-9
    return rows.where(near).orderBy(place, "id").limit(n)


def _centres(rows: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Unit centres of a small table of vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    some = rows.where(length > 0).select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    # The smallest hashes come as one partition, of which every round would be one task.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    some = materialize(some.repartition(cores, "id").drop("id"), "sample")
    if some.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=cells, seed=seed, maxIter=8, distanceMeasure="cosine", initMode="random").fit(some)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _nearest(centres: np.ndarray, vectors: pa.Array, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each vector, nearest first."""
    scores = unit_rows(vectors) @ centres.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _with_cells(df: DataFrame, centres: np.ndarray, n: int, keep: list[str]) -> DataFrame:
    """``df`` with ``cells``, the numbers of the ``n`` nearest centres of ``vector``."""
    ship_package(df.sparkSession)
    rows = df.select(*keep, "vector") if "vector" not in keep else df.select(*keep)
    cells = T.StructField("cells", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*[df.schema[c] for c in keep], cells])
    handle = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column("vector").is_valid())
            for start in range(0, whole.num_rows, 2048):
                part = whole.slice(start, 2048)
                found = _nearest(handle.value, part.column("vector"), n).astype(np.int32)
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], names=[*keep, "cells"])

    return rows.mapInArrow(run, schema)


def build_inverted_file(
    corpus: DataFrame,
    k: int = 15,
    recall: float = 0.97,
    cells: int | None = None,
    sample: int = SAMPLE,
    trial: int = TRIAL,
    seed: int = 7,
) -> InvertedFile:
    """Index every row of ``corpus`` (id, vector) for searches of the best ``k``.

    ``cells`` is four times the root of the number of rows by default. As many lists will be
    opened as hold the share ``recall`` of the exact neighbours of ``trial`` rows, which don't
    count themselves.
    """
    corpus = corpus.select("id", "vector").where(F.col("vector").isNotNull())
    total = corpus.select("id").count()
    cells = min(cells or max(1, math.ceil(4 * math.sqrt(total))), MOST_CELLS)
    centres = _centres(_by_hash(corpus, sample * cells, total), cells, seed)
    if not len(centres):
        centres = np.zeros((1, 1 if not total else len(corpus.first().vector)))
    placed = _with_cells(corpus, centres, 1, ["id", "vector"])
    lists = materialize(placed.select("id", "vector", F.col("cells")[0].alias("cell")), "lists")
    sizes = materialize(lists.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
    asked = materialize(_by_hash(corpus, trial, total).withColumnRenamed("id", "query_id"), "trial")
    exact = top_k(asked, corpus, k + 1).where("id <> query_id").join(lists.select("id", "cell"), "id")
    exact = exact.select("query_id", "cell").toArrow()
    order = _with_cells(asked, centres, len(centres), ["query_id"]).toArrow()
    ranks = {
        q: {cell: rank for rank, cell in enumerate(found)}
        for q, found in zip(order.column("query_id").to_pylist(), order.column("cells").to_pylist())
    }
    opened = sorted(ranks[q][c] for q, c in zip(exact.column("query_id").to_pylist(), exact.column("cell").to_pylist()))
    probes = 1 + opened[min(len(opened) - 1, math.ceil(recall * len(opened)) - 1)] if opened else 1
    return InvertedFile(centres, lists, sizes, probes)


def opened_lists(index: InvertedFile, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, cell): the lists that each query opens."""
    n = min(probes or index.probes, len(index.centres))
    asked = queries.select("query_id", "vector")
    return _with_cells(asked, index.centres, n, ["query_id"]).select("query_id", F.explode("cells").alias("cell"))


def scored_pairs(index: InvertedFile, queries: DataFrame, probes: int | None = None) -> int:
    """How many (query, row) pairs a search scores."""
    found = opened_lists(index, queries, probes).join(F.broadcast(index.sizes), "cell")
    return found.agg(F.sum("n")).first()[0] or 0


def search(
    index: InvertedFile,
    queries: DataFrame,
    k: int,
    probes: int | None = None,
    part_rows: int = PART_ROWS,
    part_queries: int = PART_QUERIES,
) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` rows of the lists each query opens."""
    n = min(probes or index.probes, len(index.centres))
    asked = queries.select("query_id", "vector")
    asked = _with_cells(asked, index.centres, n, ["query_id", "vector"])
    asked = materialize(asked, "asked").select("query_id", "vector", F.explode("cells").alias("cell"))
    opened = asked.groupBy("cell").agg(F.count("*").alias("q"))
    # One row per cell that is opened and not empty: how many parts each side is cut into.
    grid = index.sizes.join(opened, "cell").select(
        "cell",
        F.ceil(F.col("n") / part_rows).cast("int").alias("across"),
        F.ceil(F.col("q") / part_queries).cast("int").alias("down"),
    )
    grid = F.broadcast(materialize(grid, "grid"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(key, F.spark_partition_id()), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(grid, "cell").withColumn(f"_{own}", part).withColumn(f"_{other}", every).drop("across", "down")

    rows = dealt(index.lists, "id", "across", "down")
    asked = dealt(asked, "query_id", "down", "across")
    keys = ["cell", "_across", "_down"]
    schema = T.StructType([asked.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType())])
    empty = rows.sparkSession.createDataFrame([], schema).toArrow()

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_in_table(a, b, k) if a.num_rows and b.num_rows else empty

    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(cell, schema)
    return merge_best(found, k)
