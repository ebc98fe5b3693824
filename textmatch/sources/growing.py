"""An index that grows: rows are added, changed and removed without a rebuild.

An update is compared with what is stored by one digest per row. Only rows that are new or differ
are read whole, written as a segment, and counted; of rows that went or changed, the segment holds
the ids, and their counts are taken back. Document and term counts are sums over the segments, so
the vocabulary is exact at every version: the same as that of a fresh build. The row-wise part,
vectors and embeddings, follows from the rows and the vocabulary when it is read.

Counts of all terms take more room than the texts. From ``_MANY`` rows on a segment counts the terms of
a list, drawn once, and adds up the others in cells (``operators/tfidf.py``), in some 10 MB whatever is
counted. These are sums as well; a cell that holds no term of the vocabulary shows it, and the terms of
the other cells are counted in the rows when the index is read.

    <path>/segments/<name>/rows      id, title, embedding_text, digest
    <path>/segments/<name>/gone      ids of earlier segments that hold no longer
    <path>/segments/<name>/counts    term, df, ctf: added, or taken back (below zero); an update writes
                                     what its tasks counted, a compacted segment a row for each term
    <path>/segments/<name>/terms     the list, in the first segment that counts by it (and in a
                                     compacted one); counts of earlier segments are read no more
    <path>/segments/<name>/cells     block, sums: of the terms not in the list, added or taken back
    <path>/manifests/<version>-*     the segments in order, the number of rows, the settings,
                                     whether the counts are summed, the segment that holds the list

A manifest is written last and names all that its version consists of. One job writes at a time. A job that dies before
leaves a segment that no version names; readers see the version before. Segments never change, so
a version that is being read stays as it is. ``compact`` puts all segments into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import EngineConfig, materialize, shuffles_dropped
from textmatch.operators.tfidf import (
    SUMS,
    TERM_CELLS,
    TfidfModel,
    added,
    likely_terms,
    partial_statistics,
    pruned_vocabulary,
    settled_statistics,
    sum_rows,
    summed,
    sums_of,
    tallied,
)
from textmatch.plans.match import EncoderFactory, embed
from textmatch.sources.index import Index
from textmatch.sources.tables import path_exists

COLUMNS = ("id", "title", "embedding_text")
# Rows from which on the terms of a list are counted, and the others in cells.
_MANY = 1 << 14
# Ids that are broadcast to find their rows; more are dealt with the rows, without sorting these.
_FEW_IDS = 1 << 18
# Texts of a segment stay as long as the index: a quarter less room than by the usual codec.
ROWS_CODEC = "zstd"


@dataclass(frozen=True)
class Version:
    """What a manifest says."""

    number: int
    segments: tuple[str, ...]
    n_rows: int
    settings: str
    # One segment whose counts have a row for each term.
    summed: bool = False
    # The segment that holds the list of counted terms; none where all terms are counted.
    terms: str = ""

    @property
    def counted(self) -> tuple[str, ...]:
        """The segments whose counts hold."""
        return self.segments[self.segments.index(self.terms) :] if self.terms else self.segments


@dataclass(frozen=True)
class Changes:
    """What an update did."""

    version: int
    added: int
    changed: int
    removed: int


def _settings(cfg: EngineConfig, stop_words: Sequence[str] | None) -> str:
    kept = {"cfg": asdict(cfg), "stop_words": None if stop_words is None else sorted(stop_words)}
    return json.dumps(kept, sort_keys=True)


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The newest version whose manifest is complete; None before the first."""
    if not path_exists(spark, f"{path}/manifests"):
        return None
    kept = spark.read.schema("manifest string").json(
        f"{path}/manifests", pathGlobFilter="*.json", recursiveFileLookup=True
    )
    rows = [json.loads(r.manifest) for r in kept.collect()]
    if not rows:
        return None
    last = max(rows, key=lambda r: r["number"])
    last["segments"] = tuple(last["segments"])
    return Version(**last)


def _write_manifest(spark: SparkSession, path: str, version: Version) -> None:
    row = json.dumps(asdict(version))
    one = spark.createDataFrame([(row,)], "manifest string").coalesce(1)
    # The name is new, so what an attempt that died left isn't in the way.
    one.write.json(f"{path}/manifests/{version.number}-{uuid.uuid4().hex}")


def row_digest() -> Column:
    """One text that differs when any of the columns does; nulls are unlike empty texts."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in COLUMNS]
    return F.sha2(F.to_json(F.array(*marked)), 256)


def _config(version: Version) -> tuple[EngineConfig, Sequence[str] | None]:
    """The settings an index was begun with."""
    kept = json.loads(version.settings)
    cfg = EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept["cfg"].items()})
    return cfg, kept["stop_words"]


def _read(spark: SparkSession, path: str, version: Version, part: str) -> DataFrame:
    """One table of all segments, with the place of the segment."""
    rows = spark.read.parquet(*[f"{path}/segments/{name}/{part}" for name in version.segments])
    places = F.create_map(*[F.lit(x) for pair in enumerate(version.segments) for x in pair[::-1]])
    name = F.regexp_extract("_metadata.file_path", r"/segments/([0-9a-f]+)/", 1)
    return rows.withColumn("segment", F.element_at(places, name))


def _by_id(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with a table of ids. Texts are neither sorted nor, for a few ids, moved."""
    few = ids.limit(_FEW_IDS + 1).count() <= _FEW_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "id", how)


def _alive(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """The rows that hold: not taken back by a later segment."""
    rows = _read(spark, path, version, "rows")
    if len(version.segments) == 1:
        return rows.drop("segment")
    gone = _read(spark, path, version, "gone").groupBy("id").agg(F.max("segment").alias("until"))
    rows = _by_id(rows, gone, "left").where(F.col("until").isNull() | (F.col("until") <= F.col("segment")))
    return rows.drop("segment", "until")


def _names(spark: SparkSession, path: str, version: Version) -> list[str]:
    """The list of counted terms, in order."""
    found = spark.read.parquet(f"{path}/segments/{version.terms}/terms").toArrow()
    return found.sort_by("term")["term"].to_pylist()


def _tally(spark: SparkSession, path: str, version: Version) -> tuple[list[str], np.ndarray]:
    """The list of an index, and what is counted by it over all segments."""
    names = _names(spark, path, version)
    folders = [f"{path}/segments/{name}" for name in version.counted]
    counts = summed(spark.read.parquet(*[f"{f}/counts" for f in folders])).toArrow()
    at = pc.index_in(counts["term"], pa.array(names, pa.string())).to_numpy()
    both = np.zeros((2, len(names)), np.int64)
    both[:, at] = counts["df"].to_numpy(), counts["ctf"].to_numpy()
    cells = sums_of(added(spark.read.parquet(*[f"{f}/cells" for f in folders])), TERM_CELLS)
    return names, np.concatenate([both.ravel(), cells])


def _write_tally(spark: SparkSession, folder: str, names: list[str], sums: np.ndarray) -> None:
    df, ctf, cells = np.split(sums, [len(names), 2 * len(names)])
    some = np.flatnonzero((df != 0) | (ctf != 0))
    counts = {"term": pa.array([names[i] for i in some], pa.string()), "df": df[some], "ctf": ctf[some]}
    spark.createDataFrame(pa.table(counts), "term string, df bigint, ctf bigint").write.parquet(f"{folder}/counts")
    blocks = pa.Table.from_batches([sum_rows(cells)])
    spark.createDataFrame(blocks, SUMS).write.parquet(f"{folder}/cells")


def _write_names(spark: SparkSession, folder: str, names: list[str]) -> None:
    table = pa.table({"term": pa.array(names, pa.string())})
    spark.createDataFrame(table, "term string").write.parquet(f"{folder}/terms")


def _statistics(spark: SparkSession, path: str, version: Version) -> DataFrame:
    """``(term, df, ctf)`` of the rows that hold, of all terms that may be in the vocabulary."""
    if version.terms:
        cfg, stop_words = _config(version)
        rows = _alive(spark, path, version)
        tally = _tally(spark, path, version)
        return settled_statistics(rows, version.n_rows, *tally, "embedding_text", cfg, stop_words).where("df > 0")
    counts = _read(spark, path, version, "counts").drop("segment")
    return (counts if version.summed else summed(counts)).where("df > 0")


def update_index(
    corpus: DataFrame,
    path: str,
    cfg: EngineConfig = EngineConfig(),
    stop_words: Sequence[str] | None = None,
) -> Changes:
    """Make the index hold the rows of ``corpus`` (id, title, embedding_text), and no others.

    Ids must not repeat or be null. An update that changes nothing writes no version. An index
    keeps the settings it was begun with.
    """
    spark = corpus.sparkSession
    version = current_version(spark, path)
    settings = _settings(cfg, stop_words)
    if version is not None and version.settings != settings:
        raise ValueError(f"{path} was begun with other settings")
    given = corpus.select(*COLUMNS).withColumn("digest", row_digest())
    prints = given.groupBy("id").agg(F.max("digest").alias("new"), F.count(F.lit(1)).alias("n"))
    if version is None:
        old = spark.createDataFrame([], corpus.select("id").schema).withColumn("old", F.lit(None).cast("string"))
    else:
        old = _alive(spark, path, version).select("id", F.col("digest").alias("old"))
    both = prints.join(old, "id", "full").where("n > 1 OR id IS NULL OR NOT (new <=> old)")
    with shuffles_dropped(spark):
        both = materialize(both, "changes")
    if not both.where("n > 1 OR id IS NULL").isEmpty():
        raise ValueError("ids of a corpus must be unique and not null")
    sizes = both.agg(
        F.count_if(F.col("old").isNull()).alias("added"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("changed"),
        F.count_if(F.col("new").isNull()).alias("removed"),
    ).first()
    if both.isEmpty() and version is not None:
        return Changes(version.number, 0, 0, 0)

    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    before = (version.number, version.segments, version.n_rows) if version else (0, (), 0)
    terms = version.terms if version else ""
    made = Version(before[0] + 1, (*before[1], name), before[2] + sizes.added - sizes.removed, settings, terms=terms)
    gone = both.where("old IS NOT NULL").select("id")
    gone.write.parquet(f"{folder}/gone")
    # All rows are new to an index that holds none.
    fresh = given if version is None else _by_id(given, both.where("new IS NOT NULL").select("id"), "left_semi")
    with shuffles_dropped(spark):
        fresh.write.option("compression", ROWS_CODEC).parquet(f"{folder}/rows")
    fresh = spark.read.parquet(f"{folder}/rows")

    def lost() -> DataFrame:
        return _by_id(_alive(spark, path, version), gone, "left_semi")

    text = "embedding_text"
    if made.terms:
        names = _names(spark, path, made)
        sums = tallied(fresh, names, text, stop_words) - tallied(lost(), names, text, stop_words)
        _write_tally(spark, folder, names, sums)
    elif made.n_rows >= _MANY:
        # From here on by a list. What was counted before isn't by it: all rows are counted.
        every = fresh if version is None else given
        names = likely_terms(every, made.n_rows, text, cfg, stop_words)
        _write_names(spark, folder, names)
        _write_tally(spark, folder, names, tallied(every, names, text, stop_words))
        made = replace(made, terms=name)
    else:
        # Not summed here: readers sum over the segments anyway.
        counts = partial_statistics(fresh, text, stop_words)
        if version is not None:
            minus = partial_statistics(lost(), text, stop_words)
            counts = counts.unionByName(minus.select("term", (-F.col("df")).alias("df"), (-F.col("ctf")).alias("ctf")))
        with shuffles_dropped(spark):
            counts.write.parquet(f"{folder}/counts")
    _write_manifest(spark, path, made)
    return Changes(made.number, sizes.added, sizes.changed, sizes.removed)


def compact(spark: SparkSession, path: str) -> Version:
    """A version of the same rows in one segment."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} holds no index")
    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    rows = _alive(spark, path, version)
    with shuffles_dropped(spark):
        rows.write.option("compression", ROWS_CODEC).parquet(f"{folder}/rows")
        rows.select("id").where("false").write.parquet(f"{folder}/gone")
        if version.terms:
            names, sums = _tally(spark, path, version)
            _write_names(spark, folder, names)
            _write_tally(spark, folder, names, sums)
        else:
            _statistics(spark, path, version).write.parquet(f"{folder}/counts")
    terms = name if version.terms else ""
    made = Version(version.number + 1, (name,), version.n_rows, version.settings, summed=True, terms=terms)
    _write_manifest(spark, path, made)
    return made


def load_growing(
    spark: SparkSession,
    path: str,
    encoder: EncoderFactory | None = None,
    use_chunking: bool = True,
) -> Index:
    """The newest version, as the match plans take it. Only the vocabulary, at most
    ``max_features`` rows, is computed at once."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} holds no index")
    cfg, stop_words = _config(version)
    table = pruned_vocabulary(_statistics(spark, path, version), version.n_rows, cfg)
    with shuffles_dropped(spark):
        table = materialize(table, "vocabulary")
    model = TfidfModel(table, cfg, stop_words)
    corpus = _alive(spark, path, version).drop("digest")
    vectors = corpus.select("id", model.vector(F.col("embedding_text")).alias("vector"))
    embeddings = embed(corpus, model, "embedding_text", cfg, encoder, use_chunking)
    return Index(corpus, table, vectors, embeddings.select("id", "embedding"), model, cfg)
