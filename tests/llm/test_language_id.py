"""Language identification: held-out accuracy, and a plain version of the prediction."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.llm import language_id
from textmatch.llm.language_id import (
    UNKNOWN,
    LanguageModel,
    Machines,
    counts,
    family_of,
    features,
    held_out,
    identify,
    learn,
    op13_language_id,
    sample,
)


def plain_choice(machines, x):
    votes, sums = Counter(), Counter()
    for (a, b), w, c in zip(combinations(machines.classes, 2), machines.weights, machines.offsets):
        m = sum(p * q for p, q in zip(x, w)) + c
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    return min(machines.classes, key=lambda c: (-votes[c], -sums[c], c))


def model(seed, langs="en de fr es it xx"):
    rng = np.random.default_rng(seed)
    names = {}
    for lang in sorted(langs.split()):
        names.setdefault(family_of(lang), []).append(lang)

    def machines(classes):
        n = len(classes) * (len(classes) - 1) // 2
        return Machines(tuple(classes), rng.normal(0, 3, (n, language_id.WIDTH)), rng.normal(0, 0.1, n))

    return LanguageModel(machines(sorted(names)), {f: machines(x) for f, x in names.items()})


def test_prediction_goes_by_family_then_language():
    rng = random.Random(2)
    made = model(1)
    texts = [" ".join(rng.choice("aé bcd, x1 ñ-o ü β").strip() for _ in range(rng.randint(3, 40))) for _ in range(60)]
    texts = [t for t in texts if features(t) is not None]
    langs, scores = made.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        x = features(text)
        family = plain_choice(made.families, x)
        assert lang == plain_choice(made.languages[family], x)
        assert 0 <= score <= 1
    assert len(set(langs)) > 2


def test_counts(monkeypatch):
    found = counts("Ab 12 ÉB!")
    runs = Counter()
    for n in (1, 2, 3):
        runs.update(" ab éb "[i : i + n] for i in range(len(" ab éb ") - n + 1))
    assert found.sum() == runs.total() and sorted(found[found > 0]) == sorted(runs.values())
    assert counts(None) is None and counts("") is None and counts("12 _ \n!") is None
    assert counts("\u00bd \u00b2 \u2163") is None and counts("\u00b2x") is not None
    whole = features("abc déf " * 40_000)
    monkeypatch.setattr(language_id, "STEP", 1 << 10)
    assert np.abs(features("abc déf " * 40_000) - whole).max() < 0.05
    assert math.isclose(np.linalg.norm(whole), 1)


def test_families():
    assert family_of("en-GB") == family_of("DE") == "germanic" and family_of("q_x") == "q_x"
    codes = " ".join(language_id.FAMILIES.values()).split()
    assert len(codes) == len(set(codes))


@pytest.fixture(scope="module")
def learnt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return learn(docs.where(~held_out()))


def test_held_out_accuracy(spark, learnt):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs.where(held_out()), learnt).select("lang", "lang_pred").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 100 and right >= 0.98 * len(rows)


def test_odd_texts(spark, documents, learnt):
    rows = [(1, None), (2, ""), (3, "123 ... \n"), (4, "the and of that this with"), (4, "the and of that this with"),
            (None, "x " * 500_000), (6, "der die und nicht schön über")]
    found = identify(documents(rows, extra=("lang_pred", "score")), learnt).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert len(found) == len(rows) and got[1] == got[2] == got[3] == (UNKNOWN, 0.0)
    assert got[4][0] == "en" and got[6][0] == "de" and 0 < got[None][1] <= 1


def test_nothing_and_one_language_to_learn(spark, documents):
    docs = documents([(1, "some words"), (2, "more words"), (3, None)])
    none = learn(docs.where("false"))
    assert none.predict(["a", None]) == ([UNKNOWN, UNKNOWN], [0.0, 0.0])
    one = learn(docs)
    assert one.predict(["anything", "1"]) == (["en", UNKNOWN], [1.0, 0.0])


def test_the_sample_is_bounded_and_the_same_again(documents):
    rows = [(i, f"word {i}", "en" if i % 3 else "de") for i in range(900)] + [(5000, None, "de"), (5001, "12", "fr")]
    docs = documents(rows + [(None, "word", "en"), (5002, "word", None)])
    found = [
        sorted((r.lang, r.body) for r in sample(docs.repartition(n), "doc_id", "text", "lang", 40).collect())
        for n in (2, 7)
    ]
    assert found[0] == found[1] and Counter(lang for lang, _ in found[0]) == {"en": 40, "de": 40}


def test_query(spark, sf_dir):
    rows = op13_language_id(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    apart = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()}
    assert all(r.held_out == apart[r.doc_id] and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {r.lang for r in docs.select("lang").distinct().collect()} | {UNKNOWN}
    assert re.fullmatch(r"[a-z]+", rows[0].lang_pred)
