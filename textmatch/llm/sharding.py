"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Rows with the same text are a group and go to one shard. A row's size is its UTF-8 bytes plus
``OVERHEAD``. Packing wants the groups sorted by size in one place, so they are first brought
to a number that a constant bounds, whatever the input:

* a group with at least ``1 / UNITS`` of all bytes or of all rows is a unit of its own, of
  which there are at most ``2 * UNITS``;
* all other groups are dealt by hash into ``UNITS`` units, each a small part of a shard;
* a group larger than a shard can't be kept whole; it is dealt by id into parts of a sixteenth
  of a shard. This is the one case in which equal texts part.

On inputs of some ten thousand groups nearly every group is its own unit. The units' sizes (not
their contents) come to the driver, largest first, and each enters the bin whose remaining
capacity is the tightest, found in a balanced search tree. With a fixed capacity this minimises
the number of bins; for a fixed number of shards the capacity starts at the mean and grows
until all units fit. The assignment, as bounded as the units, is broadcast to the rows.

Slots are numbered per block (a unit, or for a unit with many rows a hashed part of it) after
an offset of the blocks before it in the shard; no task numbers a whole shard.

Defined results: a null text has no bytes, crc32 0, and its own group. Rows that repeat an id
are rows of their own. Null ids are ordered first. An empty table gives no rows. Extra columns
are ignored. Ties between units go to the unit number, between rows to the id.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.llm.common import table

SHARDS = 40
OVERHEAD = 16
UNITS = 20_480
BLOCKS = 65_536


class Tree:
    """A search tree of (remaining, bin), balanced by random but repeatable priorities."""

    def __init__(self):
        self.root = None
        self.state = 88_172_645_463_325_252

    def _priority(self) -> int:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    # A node is [key, priority, left, right].

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the smallest key with a remaining of at least ``least``."""
        low, high = self._split(self.root, (least, -1))
        found = high
        while found is not None and found[2] is not None:
            found = found[2]
        if found is not None:
            _, high = self._split(high, (found[0][0], found[0][1] + 1))
        self.root = self._join(low, high)
        return found[0] if found is not None else None


def pack(sizes: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """A bin for each size, by best fit decreasing; None if ``bins`` bins are too few.

    Without ``bins``, bins of ``capacity`` are opened as needed.
    """
    tree, out, opened = Tree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if opened == bins or sizes[i] > capacity:
                return None
            found, opened = (capacity, opened), opened + 1
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def pack_even(sizes: list[int], bins: int) -> list[int]:
    """A bin for each size, all near the mean: the least capacity, of a rising series, at which
    all fit. What is larger than an even share of what is left has a bin of its own."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, left, alone = [0] * len(sizes), sum(sizes), 0
    while alone < min(bins - 1, len(order)) and sizes[order[alone]] * (bins - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    mean = -(-left // (bins - alone))
    capacity, slack = max([mean, *[sizes[i] for i in rest[:1]]]), 1e-4
    while (found := pack([sizes[i] for i in rest], capacity, bins - alone)) is None:
        capacity = max(capacity + 1, int(mean * (1 + slack)))
        slack *= 1.7
    for i, b in zip(rest, found):
        out[i] = alone + b
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, content): what packing needs of a row. ``content`` stands for the text."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("crc"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("content"),
    )


def shard(
    docs: DataFrame,
    shards: int | None = SHARDS,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, size, crc, shard, slot). Give ``capacity`` instead of ``shards`` to open as few
    shards of that many bytes as best fit needs."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, id_col, text_col), "measured")
    groups = materialize(
        rows.groupBy("content").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups"
    )
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    bytes_, n = int(total.bytes or 0), int(total.n or 0)
    limit = capacity or max(1, -(-bytes_ // shards))
    large = groups.where(
        (F.col("bytes") * UNITS >= bytes_) | (F.col("n") * UNITS >= n)
    ).select(
        "content",
        F.lit(True).alias("own"),
        F.when(F.col("bytes") > limit, F.ceil(F.col("bytes") * 16 / limit))
        .otherwise(F.lit(1)).cast("bigint").alias("parts"),
        F.greatest(F.ceil(F.col("n") * BLOCKS / max(n, 1)), F.lit(1)).cast("bigint").alias("blocks"),
    )
    # At most 2 * UNITS rows, by the two conditions above.
    dealt = rows.join(F.broadcast(large), "content", "left")
    group, row = F.xxhash64("content"), F.xxhash64("id", F.lit(7))
    own = F.coalesce("own", F.lit(False))
    # A part is a unit of its own; blocks only divide the numbering.
    part = F.when(F.col("parts") > 1, F.pmod(row, F.col("parts"))).otherwise(F.lit(0))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", F.lit(8)), F.col("blocks")))
    dealt = materialize(
        dealt.select(
            "id", "size", "crc",
            F.when(own, F.xxhash64(group, part)).otherwise(F.pmod(group, F.lit(UNITS))).alias("unit"),
            F.when(own, block).otherwise(F.lit(0)).cast("bigint").alias("block"),
        ).na.fill(0, ["block"]),
        "dealt",
    )
    # One row per block: at most BLOCKS + 2 * UNITS for the large groups, UNITS for the rest,
    # and the parts of groups larger than a shard, 16 for each shard's worth of bytes.
    counted = dealt.groupBy("unit", "block").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")
    ).toPandas().sort_values(["unit", "block"], ignore_index=True)
    by_unit = counted.groupby("unit", sort=True)["bytes"].sum()
    sizes = [int(x) for x in by_unit]
    bins = pack(sizes, max([limit, *sizes])) if capacity else pack_even(sizes, shards)
    shard_of = dict(zip(by_unit.index, bins))
    counted["shard"] = counted["unit"].map(shard_of)
    counted["offset"] = counted.groupby("shard")["n"].cumsum() - counted["n"] if len(counted) else 0
    plan = spark.createDataFrame(
        counted[["unit", "block", "shard", "offset"]].astype("int64"),
        "unit bigint, block bigint, shard bigint, offset bigint",
    )
    inside = Window.partitionBy("unit", "block").orderBy("id", "crc", "size")
    placed = dealt.select("*", (F.row_number().over(inside) - 1).alias("at")).join(
        F.broadcast(plan), ["unit", "block"]
    )
    return placed.select(
        "id", "size", "crc",
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("at")).cast("bigint").alias("slot"),
    )


def op9_sharding(spark, sf_dir):
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
