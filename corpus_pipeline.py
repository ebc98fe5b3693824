"""From raw documents to token ids in five stages.

A stage takes and returns documents; what it rejects is gone for the stages after it, and what
it cuts from a text stays cut. Each works on all that the one before it kept:

1. ``quality``: documents that fail the base rule or the limits of their language and source go.
2. ``line_dedup``: boilerplate lines go from the texts, at all places but their first.
3. ``near_duplicates``: of each group of near-duplicates the document with the least id stays.
4. ``decontaminate``: documents that contain a window of a benchmark item go.
5. ``sentencepiece``: every text gets its piece ids, which decode to the same text.

All but the last return the columns of the documents they get, in their order; extra columns
pass through, whatever their names. ``n_chars``, where there is one, follows the text. A null
text, an empty one and one of fewer than fifty words fail the first stage. Rows that repeat an
id are one document to the third stage and stay or go together. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.llm.common import table
from textmatch.llm.decontaminate import decontaminate
from textmatch.llm.line_dedup import line_dedup
from textmatch.llm.minhash import near_duplicates
from textmatch.llm.pieces import MODEL, load_pieces
from textmatch.llm.quality import quality_filter
from textmatch.llm.sentencepiece import encode_and_check

# The columns of the documents wait under names that no operator gives to a result.
_OWN = "own_"


def _set_aside(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(_OWN + c) for c in docs.columns])


def _restored(found: DataFrame, docs: DataFrame, text_changed: bool = False) -> DataFrame:
    def back(c: str):
        if text_changed and c == "n_chars":
            kind = docs.schema[c].dataType
            return F.length(f"{_OWN}text").cast(kind).alias(c)
        return F.col(f"`{_OWN}{c}`").alias(c)

    return found.select(*map(back, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = quality_filter(
        _set_aside(docs), lang_col=f"{_OWN}lang", source_col=f"{_OWN}source", text_col=f"{_OWN}text"
    )
    return _restored(found.where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup(
        _set_aside(docs), id_col=f"{_OWN}doc_id", site_col=f"{_OWN}source", text_col=f"{_OWN}text"
    )
    return _restored(found, docs, text_changed=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = near_duplicates(docs.select("doc_id", "text"))
    gone = materialize(linked.where("id <> component_id").select("id").distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(
        _set_aside(docs), table(spark, sf_dir, "benchmark"), text_col=f"{_OWN}text"
    )
    return _restored(found.where("n_hit = 0"), docs)


def token_ids(
    spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = MODEL
) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``."""
    return encode_and_check(docs, load_pieces(model_file))


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near),
    ("decontaminate", clean_of_benchmarks),
    ("sentencepiece", token_ids),
]

# The last stage's best paths are beyond SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
