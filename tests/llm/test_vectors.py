"""Vector codes and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm import hard_negatives as hard
from textmatch.llm.hard_negatives import best_of, hard_negatives
from textmatch.llm.vector_codes import Book, compress, op11_vector_codes, with_label_error

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{id: (code, error)} and the final entries, by all distances."""
    rows = sorted(usable(rows), key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = {
        r[0]: [[math.floor(scale * float(np.float32(x))) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)]
        for r in rows
    }
    books = [[cut[r[0]][p] for r in rows[:entries]] for p in range(parts)]

    def assign(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for pieces in cut.values():
                mine[assign(p, pieces[p])[1]].append(pieces[p])
            for e, found in mine.items():
                books[p][e] = [sum(x) // len(found) for x in zip(*found)]
    out = {}
    for i, pieces in cut.items():
        found = [assign(p, x) for p, x in enumerate(pieces)]
        out[i] = ([i for _, i in found], sum(d for d, _ in found))
    return out, books


def vectors(seed, n=120, size=32, labels=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rng.randrange(6)
        rows.append((i * 3, [math.sin(centre * j) + rng.gauss(0, 0.2) for j in range(size)], rng.randrange(labels)))
    rows += [(1, None, 1), (2, [math.nan] * size, 1), (4, [None] + [0.0] * (size - 1), 2), (5, [math.inf] * size, 1)]
    rows += [(1000 + i, rows[0][1], 9) for i in range(40)] + [(2000 + i, [0.0] * size, None) for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_all_distances(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    coded, books = compress(df)
    got = {r.vec_id: (list(r.code), r.error) for r in coded.collect()}
    want, entries = plain_codes(rows)
    assert got == want and books.entries.tolist() == entries
    assert books.digest() == hashlib.sha256(
        ",".join(str(x) for book in entries for e in book for x in e).encode()
    ).hexdigest()
    sums = defaultdict(int)
    for i, _, label in usable(rows):
        sums[label] += want[i][1]
    assert {r.vec_id: r.label_error for r in with_label_error(coded).collect()} == {
        i: sums[label] for i, _, label in usable(rows)
    }


def test_the_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(4)
    entries = rng.integers(-40, 40, (16, 3))
    entries[5] = entries[11]
    pieces = np.concatenate([rng.integers(-60, 60, (3000, 3)), entries])
    index, best = Book.of(entries).nearest(pieces)
    every = ((pieces[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_few_odd_and_no_vectors(spark):
    rows = [(7, [1.0] * 8, 1), (7, [1.0] * 8, 1), (None, [0.5] * 8, None), (9, [2.0] * 16, 1), (3, [], 1),
            (4, [1.0] * 5, 1), (8, [1e30] * 8, 1), (6, [-0.3] * 8, None)]
    clash = [T.StructField("code", T.StringType()), T.StructField("error", T.IntegerType())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], T.StructType([*SCHEMA, *clash]))
    coded, books = compress(df)
    got = sorted(((r.vec_id or 0, list(r.code), r.error) for r in coded.collect()))
    assert got == [(0, [3] * 8, 0), (6, [0] * 8, 0), (7, [1] * 8, 0), (7, [1] * 8, 0)]
    assert books.count == 4
    none, books = compress(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and books is None and none.columns[-2:] == ["code", "error"]


def test_an_empty_table_of_vectors(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_vector_codes(spark, str(tmp_path)).collect() == []
    assert hard.op12_hard_negatives(spark, str(tmp_path)).collect() == []


def plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, lab in usable(rows) if lab is not None]
    out = []
    for i, lab, v in kept:
        if i not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i)
        for s, p in [(-s, j) for s, j, m in scored if m == lab][:positives]:
            near = [(-n, j) for n, j, m in scored if m != lab and low * s <= 100 * -n <= high * s][:negatives]
            out += [(i, p, k + 1, j, s, n) for k, (n, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("seed,numbers", [(1, 4 << 20), (2, 4 << 20), (3, 640)])
def test_negatives_equal_all_pairs(spark, seed, numbers, monkeypatch):
    monkeypatch.setattr(hard, "CELL_NUMBERS", numbers)  # the last: many cells on both sides
    rows = vectors(seed, n=150, labels=3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    asked = df.where(F.col("vec_id") % 5 == 0)
    got = sorted(tuple(r) for r in hard_negatives(asked, df).collect())
    want = plain_negatives(rows, {i for i, _, _ in rows if i % 5 == 0})
    assert got == want and len(want) > 50


def test_equal_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(300)] + [(i, [0.9, 0.3], 2) for i in range(300, 900)]
    rows += [(None, [1.0, 1.0], 1), (5000, [1.0], 1), (5001, [1.0, 1e30], 2), (5002, [], 1), (5003, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives(df.where("vec_id IN (0, 299, 300, 5003)"), df).collect())
    whole = [r for r in rows if r[0] is not None and r[0] < 5000]
    assert got == plain_negatives(whole, {0, 299, 300}) and got[0][:4] == (0, 1, 1, 300)


def test_a_repeated_anchor_counts_once(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.6, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r)[:4] for r in hard_negatives(df.where("vec_id = 1"), df).collect()]
    assert got == [(1, 2, 1, 3)]


def test_best_of():
    rng = np.random.default_rng(1)
    for n in range(30):
        x = rng.integers(0, 5, n).astype(float)
        assert best_of(x, 3).tolist() == sorted(range(n), key=lambda i: (-x[i], i))[:3]
