from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import PLAIN, LOWER
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import (
    WordHashes,
    join_groups,
    plain_words,
    rows_with,
    run_hashes,
)
from textmatch.llm.components import components
from textmatch.llm.spans import cut_spans


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_and_cold_groups_join_alike(spark, how):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 0, rng.randint(1, 3000), None])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, k int")
    counts = df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    counts = counts.where("k % 3 <> 1")
    got = sorted(map(str, join_groups(df, counts, ["k"], len(rows), how).select("id", "k", "m").collect()))
    want = sorted(map(str, df.join(counts.drop("n"), "k", how).select("id", "k", "m").collect()))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(a, a + 1) for a in range(0, 60)] if seed == 0 else []  # a long chain
    links += [(1000, 1000 + i) for i in range(1, 80)]  # a star
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    least = {x: x for link in links for x in link}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in least if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_words():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 _-é\x7f\x80 ſİ日.,\n") for _ in range(rng.randint(0, 25)))
        assert [w.decode() for w in plain_words(text.encode())] == PLAIN.findall(text.translate(LOWER))


def test_run_hashes_tell_runs_apart():
    hashes = WordHashes(limit=3).of([b"a", b"b", b"c", b"d", b"a", b"b", b"c"])
    runs = run_hashes(hashes, 3)
    assert len(runs) == 5 and runs[0] == runs[4] and len(set(runs.tolist())) == 4
    assert len(run_hashes(hashes, 8)) == 0 and len(run_hashes(np.empty(0, np.uint64), 1)) == 0


def test_rows_with_replaces_and_keeps(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "id int, text string, n string")
    field = T.StructField("n", T.LongType())
    out = rows_with(df, ["text"], [field], lambda c: [pa.array([len(x or "") for x in c[0].to_pylist()], pa.int64())])
    assert out.columns == ["id", "text", "n"] and [r.n for r in out.orderBy("id").collect()] == [1, 0]


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, None), (3, "abc"), (None, "x")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 9, 10), (2, 0, 1)], "doc_id long, start long, end long")
    got = {r.doc_id: r.text for r in cut_spans(docs, spans).collect()}
    assert got == {1: "01678", 2: None, 3: "abc", None: "x"}
