"""The pipeline against SQL stage by stage, and plain spelling for the last."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from textmatch.llm.decontaminate import OP2_SQL
from textmatch.llm.line_dedup import OP1_SQL
from textmatch.llm.minhash import OP3_SQL
from textmatch.llm.pieces import load_pieces
from textmatch.llm.quality import OP6_SQL
from textmatch.llm.sentencepiece import Encoder

KEEP = {
    "quality": (OP6_SQL, "SELECT d.* FROM documents d JOIN found f USING (doc_id) WHERE f.kept"),
    "line_dedup": (
        OP1_SQL,
        "SELECT d.doc_id, f.text, d.lang, d.source, length(f.text) AS n_chars "
        "FROM documents d JOIN found f USING (doc_id)",
    ),
    "near_duplicates": (OP3_SQL, "SELECT d.* FROM documents d JOIN found f USING (doc_id) WHERE f.kept"),
    "decontaminate": (
        OP2_SQL,
        "SELECT d.* FROM documents d JOIN found f USING (doc_id) WHERE NOT f.contaminated",
    ),
}


@pytest.fixture(scope="module")
def staged(sf_dir):
    """Rows after each stage, by SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = {}
    for name, (sql, keep) in KEEP.items():
        con.execute(f"CREATE OR REPLACE TABLE found AS {sql}")
        con.execute(f"CREATE OR REPLACE TABLE next AS {keep}")
        con.execute("DROP TABLE documents")
        con.execute("ALTER TABLE next RENAME TO documents")
        out[name] = con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    return out


def test_every_stage(spark, sf_dir, staged):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        got = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
        assert sorted(map(tuple, got)) == sorted(staged[name]), name


def test_run(spark, sf_dir, staged):
    encoder = Encoder(load_pieces())
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want = []
    for row in sorted(staged["decontaminate"]):
        ids = encoder.encode(row[1]).tolist()
        want.append((*row, ids, len(ids), True))
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_awkward_documents_pass_every_stage(spark, sf_dir, documents):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, None, None, None), (2, ""), (None, long), (3, long + " x"), (3, long + " x"), (4, "short"),
            (5, " ".join(f"other{i}" for i in range(60)), None, None)]
    extra = ["kept", "n_words", "component_id", "id", "line", "token", "own_text"]
    docs = documents(rows, extra)
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[: len(columns)] == columns
    found = docs.collect()
    assert sorted(str(r.doc_id) for r in found) == ["3", "3", "5"] or sorted(
        str(r.doc_id) for r in found
    ) == ["3", "3", "5", "None"]
    assert all(r.kept == "x" and r.round_trip for r in found)


def test_empty_documents(spark, sf_dir, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
