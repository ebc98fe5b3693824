from __future__ import annotations

import random

import pytest
from brute import hits

from textmatch.llm import decontaminate as decontaminate_module
from textmatch.llm.decontaminate import decontaminate, without_spans


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, None),
    (4, ""),
    (5, "short item"),
    (None, "nameless words here"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_equals_plain_search(spark, documents, block_bytes):
    rng = random.Random(3)
    words = ITEMS[0][1].split() + ["short", "item", "Ünï", "nameless", "words", "here"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, "x " + ITEMS[0][1].upper().replace(" ", ", ") + "!"), (101, None), (102, "")]
    rows += [(103, "SHORT-item"), (103, "SHORT-item"), (None, "short item")]
    found = decontaminate(documents(rows), bench(spark, ITEMS), block_bytes=block_bytes).collect()
    assert len(found) == len(rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.hit_items) for r in found)
    named = [(i, t) for i, t in ITEMS if t]
    want = []
    for i, text in rows:
        n, h, items = hits(text, named)
        want.append((str(i), n, h, [x for x in items if x != "None"]))
    assert got == sorted(want)


def test_spans_are_cut_from_the_text(spark, documents):
    rows = [(1, "keep this, Short Item! and this"), (2, "short item"), (3, None), (4, "clean")]
    found = decontaminate(documents(rows), bench(spark, ITEMS))
    out = {r.doc_id: r.t for r in found.select("doc_id", without_spans().alias("t")).collect()}
    assert out == {1: "keep this, \n! and this", 2: "\n", 3: None, 4: "clean"}


def test_empty_tables_and_clashing_names(spark, documents):
    docs = documents([(1, "short item")], extra=["n_words", "hit_items", "item"])
    found = decontaminate(docs, bench(spark, [])).first()
    assert (found.n_words, found.n_hit, found.hit_items, found.item) == (2, 0, [], "x")
    assert decontaminate(documents([]), bench(spark, ITEMS)).count() == 0


def test_very_long_text(spark, documents):
    text = "word " * 300_000 + ITEMS[0][1]
    found = decontaminate(documents([(1, text)]), bench(spark, ITEMS)).first()
    assert (found.n_words, found.n_hit, found.hit_items) == (300_012, 12, ["1"])


def test_one_block_is_held_at_a_time(spark, documents, monkeypatch):
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast

    alive, most, made = [0], [0], [0]
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def counted(self, value):
        if isinstance(value, decontaminate_module.Windows):
            alive[0] += 1
            made[0] += 1
            most[0] = max(most[0], alive[0])
        return broadcast(self, value)

    def gone(self, *a, **b):
        alive[0] -= 1
        return destroy(self, *a, **b)

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(12)]
    rows = [(i, f"a {t} b") for i, t in items] * 3 + [(99, "clean")]
    found = decontaminate(documents(rows), bench(spark, items), block_bytes=500).collect()
    assert most[0] == 1 and made[0] > 3 and alive[0] == 0
    assert sorted((r.doc_id, r.n_hit, tuple(r.hit_items)) for r in found) == sorted(
        [(i, 14, (str(i),)) for i, _ in items] * 3 + [(99, 0, ())]
    )


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_long_items_in_pieces(spark, documents, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate_module, "PIECE", 16)
    for size in (9, 10, 16, 25, 26, 100):
        words = [f"w{i}" for i in range(size)]
        rows = [(i, "x " + " ".join(words[i : i + 12]) + " y") for i in range(0, size, 5)]
        found = decontaminate(documents(rows), bench(spark, [(1, " ".join(words))]), block_bytes=block_bytes)
        got = {r.doc_id: (r.n_hit, r.hit_items) for r in found.collect()}
        for i, text in rows:
            _, n, items = hits(text, [(1, " ".join(words))])
            assert got[i] == (n, items)
