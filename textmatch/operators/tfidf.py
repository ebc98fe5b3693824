"""TF-IDF: vocabulary, document vectors, term boosting.

Fitting counts every term that may be in the vocabulary by number and adds up the others in cells.
Everything after it stays inside the document's row:
Spark parts the words by blanks, an Arrow function cuts there, counts the terms and looks their weights up in the
broadcast vocabulary (at most ``max_features`` rows), and no document is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, materialize, ship_package, shuffles_dropped, small_batches
from textmatch.functions.text import round6
from textmatch.functions.tokens import default_stop_words, spaced_words, terms

VECTOR = "array<struct<term:string,weight:double>>"
_FLOATS = pa.list_(pa.float32())
_VECTORS = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
# Documents that a task works on at once, and their words.
_EMBED_ROWS = 256
_WORDS = 1 << 17
# Words counted together when a vocabulary is fitted.
_COUNT_WORDS = 1 << 18
# Documents from which on terms that can't be in the vocabulary are no longer spelled: below, some
# of them are as frequent as wanted ones in a single document, and all words are cut twice.
_MANY = 1 << 16
# Documents drawn to guess the frequent terms, guesses for each wanted term, cells that add up the
# other terms, and numbers in a row of such sums.
_DRAWN = 4096
_LIKELY = 8
TERM_CELLS = 1 << 20
_SUMS = 1 << 15


def term_statistics(
    docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """``(term, df, ctf)``: documents holding a term, and its occurrences.

    The counts are combined on the map side, so a term found in most documents costs one row per
    task in the shuffle.
    """
    return summed(partial_statistics(docs, text_col, stop_words))


def summed(counts: DataFrame) -> DataFrame:
    """One row for each term from ``(term, df, ctf)`` rows."""
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def partial_statistics(
    docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """The same as rows that are still to be summed by term; nothing is shuffled.

    Spark parts the words; an Arrow function counts the terms of some documents at a time, as
    numbers, and spells each distinct one once.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    stop = _stop_array(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(_cut(batch.column("words")), _COUNT_WORDS):
                yield _counted(part, stop)

    found = docs.select(spaced_words(F.col(text_col)).alias("words"))
    return found.mapInArrow(count, "term string, df bigint, ctf bigint")


def vocabulary(
    docs: DataFrame,
    text_col: str = "text",
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
    n_docs: int | None = None,
) -> DataFrame:
    """``(term, df, ctf, idf)``: the ``max_features`` most frequent terms after pruning."""
    n = docs.count() if n_docs is None else n_docs
    if n < _MANY:
        return pruned_vocabulary(term_statistics(docs, text_col, stop_words), n, cfg)
    return pruned_vocabulary(frequent_statistics(docs, n, text_col, cfg, stop_words), n, cfg)


def frequent_statistics(
    docs: DataFrame,
    n: int,
    text_col: str = "text",
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of :func:`term_statistics` that may be in the vocabulary of ``n`` documents.

    Most terms are rare, and spelling, shuffling and grouping them is most of the work of counting.
    A few drawn documents only say which terms are probably frequent. These are counted by number
    over all documents; every other term adds its occurrences to a cell chosen by its hash. As
    many likely terms as are wanted reach some count; a term below it isn't in the vocabulary, and a
    cell below it holds no term that reaches it. The terms of all other cells are counted one by
    one. So the counts are exact whatever was drawn.
    """
    names = likely_terms(docs, n, text_col, cfg, stop_words)
    sums = tallied(docs, names, text_col, stop_words)
    return settled_statistics(docs, n, names, sums, text_col, cfg, stop_words)


def likely_terms(
    docs: DataFrame,
    n: int,
    text_col: str = "text",
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
) -> list[str]:
    """Terms that are probably frequent in ``n`` documents, by a few of these, in order."""
    drawn = term_statistics(docs.sample(min(1.0, _DRAWN / max(n, 1)), 42), text_col, stop_words)
    likely = drawn.orderBy(F.desc("ctf"), "term").limit(_LIKELY * cfg.max_features)
    return likely.select("term").toArrow().sort_by("term")["term"].to_pylist()


def tallied(
    docs: DataFrame, names: list[str], text_col: str = "text", stop_words: Sequence[str] | None = None
) -> np.ndarray:
    """``df`` and ``ctf`` of each of the ``names``, and the occurrences of all other terms added up
    in cells: one after the other in an array whose size doesn't depend on the documents. Tallies
    of several tables, with the same names, add up to that of their union."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    stop = _stop_array(stop_words)
    shared = spark.sparkContext.broadcast(_Terms(names))
    size = len(names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums = shared.value, np.zeros(2 * size + TERM_CELLS, np.int64)
        df, ctf, cells = np.split(sums, [size, 2 * size])
        for batch in batches:
            for part in _parts(_cut(batch.column("words")), _COUNT_WORDS):
                names, codes, found, often = _tallied(part, stop)
                at = terms.positions(names, codes)
                known, rest = at >= 0, at < 0
                df[at[known]] += found[known]
                ctf[at[known]] += often[known]
                np.add.at(cells, _term_cells(names, codes[rest]), often[rest])
        yield sum_rows(sums)

    words = docs.select(spaced_words(F.col(text_col)).alias("words"))
    with shuffles_dropped(spark):
        blocks = materialize(added(words.mapInArrow(tally, SUMS)), "sums")
    return sums_of(blocks, 2 * size + TERM_CELLS)


def added(blocks: DataFrame) -> DataFrame:
    """The sums of rows as made by :func:`sum_rows`, block by block."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SUMS, np.int64)
        for some in rows:
            for block in some.column("sums").to_pylist():
                total += np.frombuffer(block, np.int64)
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "sums": [total.tobytes()]}, _SUM_SCHEMA)

    return blocks.groupBy("block").applyInArrow(add, SUMS)


def sums_of(blocks: DataFrame, size: int) -> np.ndarray:
    """The numbers that added blocks hold; zeros for none."""
    found = np.frombuffer(b"".join(blocks.toArrow().sort_by("block")["sums"].to_pylist()), np.int64)
    return found[:size] if len(found) else np.zeros(size, np.int64)


def settled_statistics(
    docs: DataFrame,
    n: int,
    names: list[str],
    sums: np.ndarray,
    text_col: str = "text",
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """What :func:`frequent_statistics` says, from the tally of all ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    stop = _stop_array(stop_words)
    size = len(names)
    df, ctf, cells = np.split(sums, [size, 2 * size])
    wanted = np.sort(ctf[(df >= cfg.min_df) & (df <= cfg.max_df * n)])[::-1]
    least = max(1, cfg.min_df)
    if len(wanted) >= cfg.max_features > 0:
        least = max(least, int(wanted[cfg.max_features - 1]))
    kept = np.flatnonzero(ctf >= least)
    table = pa.table(
        {
            "term": pa.array([names[i] for i in kept], pa.string()),
            "df": pa.array(df[kept], pa.int64()),
            "ctf": pa.array(ctf[kept], pa.int64()),
        }
    )
    counted = spark.createDataFrame(table, "term string, df bigint, ctf bigint")
    heavy = cells >= least
    if not heavy.any():
        return counted
    shared = spark.sparkContext.broadcast((_Terms(names), heavy))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, heavy = shared.value
        for batch in batches:
            for part in _parts(_cut(batch.column("words")), _COUNT_WORDS):
                names, codes, found, often = _tallied(part, stop)
                rest = heavy[_term_cells(names, codes)]
                rest &= terms.positions(names, codes) < 0
                yield _spelled(names, codes[rest], found[rest], often[rest])

    words = docs.select(spaced_words(F.col(text_col)).alias("words"))
    more = words.mapInArrow(others, "term string, df bigint, ctf bigint")
    return counted.unionByName(summed(more))


def pruned_vocabulary(
    statistics: DataFrame, n: int, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """The vocabulary of ``n`` documents from their ``(term, df, ctf)``."""
    return (
        statistics.filter((F.col("df") >= cfg.min_df) & (F.col("df") <= cfg.max_df * n))
        .orderBy(F.desc("ctf"), "term")
        .limit(cfg.max_features)
        .withColumn("idf", F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0)
    )


def _stop_array(stop_words: Sequence[str] | None) -> pa.Array:
    return pa.array(list(default_stop_words() if stop_words is None else stop_words), pa.string())


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row number of every list element, and the elements."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _ends(lists: pa.Array) -> np.ndarray:
    """How many words the rows up to each one hold, at whatever depth of lists."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    if pa.types.is_list(lists.type.value_type):
        ends = np.concatenate([[0], _ends(lists.flatten())])[ends]
    return ends


def _parts(lists: pa.Array, words: int, rows: int | None = None) -> Iterator[pa.Array]:
    """The rows in runs of at most ``words`` words and ``rows`` rows; a longer row is alone."""
    ends, lo = _ends(lists), 0
    while lo < len(lists):
        held = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, held + words, "right")))
        hi = hi if rows is None else min(hi, lo + rows)
        yield lists.slice(lo, hi - lo)
        lo = hi


def _worked(lists: pa.Array, fn: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``fn`` of a few rows at a time."""
    done = [fn(part) for part in _parts(lists, _WORDS, _EMBED_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists from elements ordered by row number."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _cut(spaced: pa.Array) -> pa.Array:
    """Lists of the words of :func:`spaced_words`."""
    rows, pieces = _flat(pc.split_pattern(spaced, " "))
    long = pc.greater(pc.utf8_length(pieces), 1)
    return _lists(rows[long.to_numpy(zero_copy_only=False)], len(spaced), pieces.filter(long))


def _cut_lists(spaced: pa.Array) -> pa.Array:
    """The same for lists of chunks."""
    rows, flat = _flat(spaced)
    return _lists(rows, len(spaced), _cut(flat))


def _kept(found: pa.Array, stop: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and word of all words but the stop words."""
    rows, flat = _flat(found)
    if not len(stop):
        return rows, flat
    kept = pc.invert(pc.is_in(flat, value_set=stop))
    return rows[kept.to_numpy(zero_copy_only=False)], flat.filter(kept)


def _tallied(found: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some documents, and ``(code, df, ctf)`` of their unigrams and bigrams.

    With ``size`` words, the code of a unigram is its word's number, and that of a bigram
    ``size + left * size + right``; codes ascend.
    """
    rows, kept = _kept(found, stop)
    coded = kept.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size, n = max(len(names), 1), max(len(found), 1)
    near = rows[1:] == rows[:-1]
    pairs = size + code[:-1][near] * size + code[1:][near]
    cells = np.concatenate([code * n + rows, pairs * n + rows[1:][near]])
    cells, tf = np.unique(cells, return_counts=True)
    terms = cells // n
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    terms, df = terms[first], np.diff(first, append=len(cells))
    ctf = np.add.reduceat(tf, first) if len(first) else tf
    return names, terms, df, ctf


def _halves(names: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' numbers of the unigrams among ascending codes, and both of the bigrams."""
    size = max(len(names), 1)
    cut = int(np.searchsorted(codes, size))
    return codes[:cut], *np.divmod(codes[cut:] - size, size)


def _spelled(names: pa.Array, codes: np.ndarray, df: np.ndarray, ctf: np.ndarray) -> pa.RecordBatch:
    """``(term, df, ctf)`` rows of terms given by code."""
    single, left, right = _halves(names, codes)
    two = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), " ")
    one = names.take(pa.array(single))
    return pa.RecordBatch.from_pydict(
        {
            "term": pa.concat_arrays([one, two]),
            "df": pa.array(df, pa.int64()),
            "ctf": pa.array(ctf, pa.int64()),
        }
    )


def _counted(found: pa.Array, stop: pa.Array) -> pa.RecordBatch:
    """``(term, df, ctf)`` of the unigrams and bigrams of some documents."""
    return _spelled(*_tallied(found, stop))


def _hashes(words: pa.Array) -> np.ndarray:
    """A polynomial in the bytes of each word; equal hashes of different words do no harm."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends -= ends[0]
    sizes = np.diff(ends)
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
    return np.add.reduceat(data * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)], ends[:-1])


def _term_cells(names: pa.Array, codes: np.ndarray) -> np.ndarray:
    """A cell for each term, the same in every task."""
    word = _hashes(names)
    single, left, right = _halves(names, codes)
    mixed = np.concatenate([word[single], word[left] * np.uint64(0x9E3779B97F4A7C15) + word[right]])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(TERM_CELLS)).astype(np.int64)


SUMS = "block int, sums binary"
_SUM_SCHEMA = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def sum_rows(sums: np.ndarray) -> pa.RecordBatch:
    """Numbers in rows of ``_SUMS``, the last one filled up with zeros."""
    blocks = np.pad(sums, (0, -len(sums) % _SUMS)).reshape(-1, _SUMS)
    rows = {"block": np.arange(len(blocks), dtype=np.int32), "sums": [b.tobytes() for b in blocks]}
    return pa.RecordBatch.from_pydict(rows, _SUM_SCHEMA)


class _Terms:
    """Terms as arrays; lives in a broadcast. A bigram is looked up by its words' numbers."""

    def __init__(self, names: list[str]):
        self.terms = pa.array(names, pa.string())
        split = [t.split(" ") for t in names]
        number = {w: i for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.words = pa.array(list(number), pa.string())
        self.single = np.full(len(number), -1, np.int64)
        pairs = []
        for pos, t in enumerate(split):
            if len(t) == 1:
                self.single[number[t[0]]] = pos
            elif len(t) == 2:
                pairs.append((number[t[0]] * len(number) + number[t[1]], pos))
        self.pairs = pa.array([key for key, _ in pairs], pa.int64())
        self.pair_pos = np.array([pos for _, pos in pairs], np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for one that is in no term."""
        word = pc.fill_null(pc.index_in(words, self.words), -1)
        return word.to_numpy(zero_copy_only=False).astype(np.int64)

    def of_single(self, word: np.ndarray) -> np.ndarray:
        """The position of each word's unigram, -1 for none."""
        one = np.full(len(word), -1, np.int64)
        one[word >= 0] = self.single[word[word >= 0]]
        return one

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The position of each bigram of known words, -1 for none."""
        keys = left * len(self.words) + right
        at = pc.fill_null(pc.index_in(pa.array(keys, pa.int64()), self.pairs), -1)
        at = at.to_numpy(zero_copy_only=False)
        out = np.full(len(at), -1, np.int64)
        out[at >= 0] = self.pair_pos[at[at >= 0]]
        return out

    def positions(self, names: pa.Array, codes: np.ndarray) -> np.ndarray:
        """The position of each term given by code, -1 for none."""
        word = self.numbers(names)
        single, left, right = _halves(names, codes)
        left, right = word[left], word[right]
        known = (left >= 0) & (right >= 0)
        two = np.full(len(left), -1, np.int64)
        two[known] = self.of_pairs(left[known], right[known])
        return np.concatenate([self.of_single(word[single]), two])


class _Lookup(_Terms):
    """Vocabulary with its weights and places in a hashed vector."""

    def __init__(self, names: list[str], idf: np.ndarray, dim: int, stop: pa.Array):
        super().__init__(names)
        self.idf = idf
        self.stop = stop
        digests = [hashlib.md5(t.encode()).hexdigest() for t in names]
        self.dim = dim
        self.slot = np.array([int(d[:8], 16) % dim for d in digests], np.int64)
        self.sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])

    def weigh(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, vocabulary position and unit-length weight of the known terms of lists of words."""
        rows, kept = _kept(found, self.stop)
        word = self.numbers(kept)
        one = self.of_single(word)
        near = (rows[1:] == rows[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
        two = self.of_pairs(word[:-1][near], word[1:][near])
        size = max(len(self.terms), 1)
        single = rows[one >= 0] * size + one[one >= 0]
        double = rows[1:][near][two >= 0] * size + two[two >= 0]
        cells, tf = np.unique(np.concatenate([single, double]), return_counts=True)
        rows, pos = cells // size, cells % size
        weight = tf * self.idf[pos]
        length = np.sqrt(np.bincount(rows, weight * weight, len(found)))
        return rows, pos, weight / length[rows]

    def heaviest(
        self, rows: np.ndarray, pos: np.ndarray, weight: np.ndarray, n: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``n`` heaviest terms of each row, in the order of :func:`top_terms`, by position."""
        order = np.lexsort((pos, -np.floor(weight * 1e6 + 0.5), rows))
        first = np.searchsorted(rows, rows, "left")
        kept = np.sort(order[np.arange(len(rows)) - first < n])
        return rows[kept], pos[kept], weight[kept]

    def embed(self, found: pa.Array) -> np.ndarray:
        """Pooled hashed vectors of documents given as lists of chunks."""
        owner, per_chunk = _flat(found)
        rows, pos, weight = self.weigh(per_chunk)
        slots, size = rows * self.dim + self.slot[pos], len(per_chunk) * self.dim
        dense = np.bincount(slots, weight * self.sign[pos], size).astype(float, copy=False)
        return pool_unit(dense.reshape(-1, self.dim), owner, len(found))

    def vectors(self, rows: np.ndarray, pos: np.ndarray, weight: np.ndarray, n: int):
        items = pa.StructArray.from_arrays(
            [self.terms.take(pa.array(pos)), pa.array(weight, pa.float64())],
            names=["term", "weight"],
        )
        return _lists(rows, n, items)


class TfidfModel:
    """A fitted vocabulary with its document transforms as column expressions."""

    def __init__(
        self,
        table: DataFrame,
        cfg: EngineConfig = EngineConfig(),
        stop_words: Sequence[str] | None = None,
    ):
        ship_package(table.sparkSession)
        small_batches(table.sparkSession)
        self.table = table
        self.cfg = cfg
        self.stop_words = stop_words
        # At most cfg.max_features rows: the one corpus statistic that is broadcast. A table
        # with more was fitted with other settings and isn't cut.
        kept = table.select("term", "idf").limit(cfg.max_features + 1).toArrow()
        if kept.num_rows > cfg.max_features:
            raise ValueError(f"the vocabulary has more than max_features = {cfg.max_features} terms")
        kept = kept.sort_by("term")
        lookup = _Lookup(
            kept["term"].to_pylist(),
            kept["idf"].to_numpy().astype(float),
            cfg.dim,
            _stop_array(stop_words),
        )
        self.lookup = table.sparkSession.sparkContext.broadcast(lookup)

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        text_col: str = "text",
        cfg: EngineConfig = EngineConfig(),
        stop_words: Sequence[str] | None = None,
    ) -> TfidfModel:
        """Fit on ``docs``; the vocabulary is written once and reused by later jobs."""
        table = materialize(vocabulary(docs, text_col, cfg, stop_words), "vocabulary")
        return cls(table, cfg, stop_words)

    def terms(self, text: Column) -> Column:
        return terms(text, self.stop_words)

    def vector(self, text: Column, heaviest: int | None = None) -> Column:
        """Unit-length TF-IDF vector in term order; unknown terms are dropped. With ``heaviest``
        only so many terms of the vector."""
        shared = self.lookup

        def part(found: pa.Array) -> pa.Array:
            model = shared.value
            cells = model.weigh(found)
            if heaviest is not None:
                cells = model.heaviest(*cells, heaviest)
            return model.vectors(*cells, len(found))

        @F.arrow_udf(VECTOR)
        def weigh(found: pa.Array) -> pa.Array:
            return _worked(_cut(found), part, _VECTORS)

        return weigh(spaced_words(text))

    def mean_vector(self, chunks: Column) -> Column:
        """Mean of the chunks' unit-length vectors, not scaled back to unit length."""
        shared = self.lookup

        def part(found: pa.Array) -> pa.Array:
            model = shared.value
            owner, per_chunk = _flat(found)
            rows, pos, weight = model.weigh(per_chunk)
            size = max(len(model.terms), 1)
            cells, where = np.unique(owner[rows] * size + pos, return_inverse=True)
            total = np.bincount(where, weight, len(cells))
            docs, pos = cells // size, cells % size
            n_chunks = np.bincount(owner, minlength=len(found))
            return model.vectors(docs, pos, total / n_chunks[docs], len(found))

        @F.arrow_udf(VECTOR)
        def pool(found: pa.Array) -> pa.Array:
            return _worked(_cut_lists(found), part, _VECTORS)

        return pool(F.transform(chunks, spaced_words))

    def embedding(self, chunks: Column) -> Column:
        """The built-in encoder: weights hashed with a sign into ``dim`` slots per chunk,
        scaled, averaged over the chunks and scaled again. Text without a known term gives
        the zero vector."""
        shared = self.lookup

        @F.arrow_udf("array<float>")
        def embed(found: pa.Array) -> pa.Array:
            cut = _cut_lists(found)
            return _worked(cut, lambda part: to_float_lists(shared.value.embed(part)), _FLOATS)

        return embed(F.transform(chunks, spaced_words))


def to_float_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow ``list<float>`` array."""
    n, dim = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(matrix.ravel(), pa.float32())
    )


def pool_unit(vectors: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Scale each vector, average by owner, scale the averages; zero stays zero."""

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    total = np.zeros((n, vectors.shape[1]))
    np.add.at(total, owner, unit(vectors))
    counts = np.maximum(np.bincount(owner, minlength=n), 1)
    return unit(total / counts[:, None])


def top_terms(vector: Column, n: int = 20) -> Column:
    """The ``n`` heaviest terms, ``array<struct<term, weight>>``; ties by term."""
    keyed = F.transform(
        vector,
        lambda x: F.struct(
            (-round6(x["weight"])).alias("order"), x["term"], x["weight"]
        ),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, n),
        lambda x: F.struct(x["term"], x["weight"]),
    )


def boost_text(text: Column, vector: Column, n: int = 20, sep: str = "") -> Column:
    """Append the heaviest terms, each repeated one to five times by weight.

    More than ``n`` terms are appended lightest first, otherwise all in term order. The
    default joins the repeats of a term without a blank.
    """

    def repeats(x: Column) -> Column:
        times = F.least(
            F.lit(5), F.greatest(F.lit(1), F.floor(round6(x["weight"]) * 10).cast("int"))
        )
        return F.concat(F.lit(" "), F.array_join(F.array_repeat(x["term"], times), sep))

    v = vector
    chosen = F.when(F.size(v) > n, F.reverse(top_terms(v, n))).otherwise(v)
    return F.concat(text, F.array_join(F.transform(chosen, repeats), ""))


def postings(docs: DataFrame, vector_col: str = "vector", id_col: str = "id") -> DataFrame:
    """The document-term matrix as ``(id, term, weight)`` rows.

    The outer form keeps Spark from inferring a filter on the vector, which would compute
    the vector a second time.
    """
    rows = docs.select(id_col, F.inline_outer(vector_col))
    return rows.filter(F.col("term").isNotNull())
