"""Every query against every row, in bounded cells that Spark shuffles together.

Both sides are dealt into groups of a bounded size; a cell is one group of queries with one
group of rows, and one task at a time holds one cell. Queries are copied to each group of rows
and rows to each group of queries, so what is moved grows with the number of groups, not with
the pairs. Nothing passes through the driver. One job holds at most ``COPIES`` copies of the
rows; with more groups of queries, jobs follow one another, each written and its shuffle removed
before the next, and the plan that reads them is one scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, scratch_path, ship_package, shuffles_dropped

# Rows below which a side isn't cut only to give more cores a share.
SMALL = 2048
# Partitions of the shuffle; more cells than that take turns.
MOST_PARTITIONS = 20_000
# Groups of queries, so copies of the rows, in one job.
COPIES = 2


def groups_of(rows: int, most: int, cores: int) -> int:
    """Groups of at most ``most`` rows, on average; a few per core where the rows allow."""
    return max(1, math.ceil(rows / most), min(2 * cores, math.ceil(rows / SMALL)))


def _dealt(df: DataFrame, groups: int, key: str) -> Column:
    """A group by hash. Rows that repeat a key are spread by the partition they come from."""
    return F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(groups))


def in_cells(
    queries: DataFrame,
    items: DataFrame,
    fn: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType | str,
    n_queries: int,
    n_items: int,
    query_rows: int,
    item_rows: int,
    query_key: str = "query_id",
    item_key: str = "id",
) -> DataFrame:
    """What ``fn(queries, items)`` gives for each cell; ``fn`` never sees an empty side.

    ``query_rows`` and ``item_rows`` bound the mean group of each side, ``n_queries`` and
    ``n_items`` are the rows there are, or more. Queries aren't cut for more parallel tasks,
    as each group of them takes a copy of all items. Both sides must give the same rows
    whenever they are read again (a scan or a written table).
    """
    ship_package(items.sparkSession)
    cores = items.sparkSession.sparkContext.defaultParallelism
    across = groups_of(n_items, item_rows, cores)
    down = max(1, math.ceil(n_queries / query_rows))

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    empty = items.sparkSession.createDataFrame([], schema).toArrow()

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b) if a.num_rows and b.num_rows else empty

    def every(low: int, high: int) -> Column:
        return F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint")))

    def job(low: int, high: int) -> DataFrame:
        """The cells of the query groups from ``low`` to before ``high``."""
        left = queries.withColumn("_down", _dealt(queries, down, query_key))
        if high - low < down:
            left = left.where(F.col("_down").between(low, high - 1))
        left = left.withColumn("_across", every(0, across))
        right = items.withColumn("_across", _dealt(items, across, item_key))
        one = F.lit(low).cast("bigint")
        right = right.withColumn("_down", every(low, high) if high - low > 1 else one)
        n_cells = across * (high - low)
        parts = min(n_cells, MOST_PARTITIONS)

        def put(df: DataFrame) -> DataFrame:
            number = ((F.col("_down") - low) * across + F.col("_across")).cast("int").alias("_cell")
            dealt = df.select(*[c for c in df.columns if c not in ("_down", "_across")], number)
            # A partition for each cell is what grouping by cell needs: nothing is shuffled twice, and no
            # cells that take as long as others are put into one task because they hold few bytes.
            own = F.col("_cell") if parts == n_cells else F.pmod("_cell", F.lit(parts)).cast("int")
            return dealt.repartitionById(parts, own)

        grouped = put(left).groupBy("_cell").cogroup(put(right).groupBy("_cell"))
        return grouped.applyInArrow(cell, schema)

    if down <= COPIES:
        return job(0, down)
    queries, items = materialize(queries, "queries"), materialize(items, "items")
    path = scratch_path(items.sparkSession, "cells")
    for low in range(0, down, COPIES):
        with shuffles_dropped(queries.sparkSession):
            job(low, min(low + COPIES, down)).write.mode("append").parquet(path)
    return items.sparkSession.read.schema(schema).parquet(path)
