"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import workload.queries
from textmatch.sources.index import open_index

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def text(x):
        return "~" if x is None else repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(found.fetchall(), columns)


def test_inline_texts_take_every_passage(spark, sf_dir):
    shown = entry.queries()["inline_texts"](spark, sf_dir)
    asked = {r.query_id for r in shown.select("query_id").distinct().collect()}
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert {f"b{r.item_id}" for r in passages.collect()} <= asked


def test_an_index_round_trip_prepares_its_corpus_once(spark, sf_dir, monkeypatch):
    """three jobs read the corpus; none of them cleans its texts again."""
    plans = []

    def opened(corpus, *args):
        plans.append(corpus._jdf.queryExecution().optimizedPlan().toString())
        return open_index(corpus, *args)

    monkeypatch.setattr(workload.queries, "open_index", opened)
    entry.queries()["index_roundtrip"](spark, sf_dir)
    assert len(plans) == 2 and not any("regexp_replace" in plan for plan in plans)


def test_index_recall_counts_more_pairs_than_an_int_holds(spark, tmp_path):
    """every row of this table asks, so there are more than 2**31 pairs."""
    n = 46_400
    turn = F.col("id") * 6.283185307 / n
    rows = spark.range(n).select(
        (F.col("id") * 50).alias("vec_id"),
        F.array(F.cos(turn), F.sin(turn)).cast("array<float>").alias("embedding"),
        F.lit(1).alias("label"),
    )
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()["index_recall"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(15 * n, True, True)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
