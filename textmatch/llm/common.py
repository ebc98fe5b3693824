"""What the corpus operators share: reading tables, words, and Arrow passes over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import ship_package

# Bytes that separate the words of a benchmark comparison; A-Z become a-z.
_PLAIN = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def lower_ascii(text: bytes) -> bytes:
    return text.lower()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes; nulls stay None."""
    return column.cast(pa.large_binary()).to_pylist()


def rows_with(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    fn: Callable[[list[pa.Array]], list[pa.Array]],
    carry: Sequence[str] | None = None,
    slice_rows: int = 512,
) -> DataFrame:
    """Add columns that ``fn`` computes from ``inputs``, row by row, through Arrow.

    ``carry`` names the columns kept (all by default). A new column replaces one of the same
    name. No row moves; a slice of ``slice_rows`` rows is in memory at a time.
    """
    ship_package(df.sparkSession)
    added = [f.name for f in fields]
    kept = [c for c in (df.columns if carry is None else carry) if c not in added]
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType([*[source.schema[c] for c in kept], *fields])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                part = whole.slice(start, slice_rows)
                made = fn([part.column(part.schema.get_field_index(c)) for c in inputs])
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *added])

    return source.mapInArrow(run, schema)


_PLACES = 1 << 31


def place(id_col: str = "id", at_col: str = "at") -> Column:
    """(id, place in the document) as one number, so that its minimum is a hash aggregate."""
    return F.expr(f"cast({id_col} AS decimal(20, 0)) * {_PLACES}BD + {at_col}")


def place_at(number: str) -> Column:
    return F.expr(f"cast(pmod({number}, {_PLACES}BD) AS bigint)")


def place_id(number: str) -> Column:
    return F.expr(f"cast(({number} - pmod({number}, {_PLACES}BD)) / {_PLACES}BD AS bigint)")


# A group with at least this part of all rows is hot; there can be no more such groups.
HOT = 1024


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner"
) -> DataFrame:
    """``rows`` joined with ``groups``, one row per key, whose ``n`` counts the key's rows.

    The ``HOT`` groups at most that hold a ``HOT``th of the ``total`` rows are broadcast, so
    their rows stay where they are; all others are small parts of a shuffled join.
    """
    large = F.col("n") * HOT >= total
    hot, rest = F.broadcast(groups.where(large).drop("n")), groups.where(~large).drop("n")
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how)
    return rows.join(hot, keys).unionByName(cold)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered for as many words as ``limit``.

    The memory only saves time: a forgotten word is hashed again, to the same value.
    """

    def __init__(self, limit: int = 200_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.digest, self.limit = xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self.digest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit hash for each run of ``length`` neighbouring values."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + count]
    return mix64(out)
