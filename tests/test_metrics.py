"""Metrics against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from textmatch.operators import metrics as M

RANKING = "query_id string, rank int, item_id string"
TRUTH = "query_id string, item_id string, relevance double"


def brute(ranked, truth, k, t):
    """All metrics of one query from its ordered items and its truth."""
    rel = [truth.get(i) for i in ranked]
    hit = [r is not None and r >= t for r in rel]
    gain = sum((r or 0) / math.log2(i + 2) for i, r in enumerate(rel[:k]))
    ideal = sum(
        r / math.log2(i + 2) for i, r in enumerate(sorted(truth.values(), reverse=True)[:k])
    )
    known = sum(r >= t for r in truth.values())
    first = next((i + 1 for i, h in enumerate(hit) if h), None)
    found, total = 0, 0.0
    for i, h in enumerate(hit):
        if h:
            found += 1
            total += found / (i + 1)
    label = {i: int(r) if r >= t else 0 for i, r in truth.items()}
    pred = {i: n // 5 for n, i in enumerate(ranked)}
    common = [i for i in pred if i in label]
    out = {
        "ndcg": gain / ideal if ideal > 0 else 0.0,
        "precision": sum(hit[:k]) / len(hit[:k]) if hit[:k] else 0.0,
        "recall": 1.0 if known == 0 else sum(hit[:k]) / known,
        "mrr": 1 / first if first else 0.0,
        "map": 1.0 if known == 0 else total / known,
        "ari": 0.0,
        "nmi": 0.0,
    }
    if len(common) >= 2:
        pairs = [(pred[i], label[i]) for i in common]
        out["ari"] = pair_rand(pairs)
        out["nmi"] = mutual(pairs)
    groups = {}
    for n, i in enumerate(ranked):
        if i in label:
            groups.setdefault(n // 5, []).append(label[i])
    size = sum(map(len, groups.values()))
    top = sum(Counter(g).most_common(1)[0][1] for g in groups.values())
    out["purity"] = top / size if size else 0.0
    return out


def pair_rand(pairs):
    """Adjusted Rand index by counting pairs of items."""
    n = len(pairs)
    same_both = same_p = same_l = 0
    for a in range(n):
        for b in range(a + 1, n):
            p, l = pairs[a][0] == pairs[b][0], pairs[a][1] == pairs[b][1]
            same_both += p and l
            same_p += p
            same_l += l
    everything = n * (n - 1) / 2
    expected = same_p * same_l / everything
    best = (same_p + same_l) / 2
    return 1.0 if best == expected else (same_both - expected) / (best - expected)


def mutual(pairs):
    n = len(pairs)
    p, l, both = (Counter(x) for x in ([a for a, _ in pairs], [b for _, b in pairs], pairs))
    if len(p) == 1 and len(l) == 1:
        return 1.0
    info = sum(c / n * math.log(n * c / (p[a] * l[b])) for (a, b), c in both.items())
    entropy = sum(-c / n * math.log(c / n) for x in (p, l) for c in x.values())
    return 0.0 if info < 1e-12 else info / (entropy / 2)


def frames(spark, ranked, truth):
    r = [(q, n + 1, i) for q, items in ranked.items() for n, i in enumerate(items)]
    t = [(q, i, v) for q, rows in truth.items() for i, v in rows.items()]
    return spark.createDataFrame(r, RANKING), spark.createDataFrame(t, TRUTH)


def check(spark, ranked, truth, ks, ts):
    rows = M.evaluate(*frames(spark, ranked, truth), ks, ts).collect()
    seen = set()
    for r in rows:
        t = ts[0] if r.threshold is None else r.threshold
        want = brute(ranked[r.query_id], truth[r.query_id], r.k or 1, t)[r.metric]
        assert r.value == pytest.approx(want, abs=1e-9), r
        seen.add((r.query_id, r.metric, r.k, r.threshold))
    per_query = len(ks) * (1 + 2 * len(ts)) + 5 * len(ts)
    assert len(seen) == len(rows) == per_query * len(set(ranked) & set(truth))


def test_literal_example(spark):
    ranked, truth = {"q": list("abc")}, {"q": {"a": 0.0, "b": 2.0, "c": 1.0, "d": 3.0}}
    rows = M.evaluate(*frames(spark, ranked, truth), (3,)).collect()
    got = {r.metric: r.value for r in rows}
    expected = {
        "ndcg": 0.369994, "precision": 2 / 3, "recall": 2 / 3, "mrr": 0.5, "map": 0.388889,
        "purity": 1 / 3, "ari": 0.0, "nmi": 0.0,
    }
    assert got == pytest.approx(expected, abs=1e-6)


def test_random_lists_with_repeats(spark):
    rng = random.Random(3)
    items = [f"i{n}" for n in range(25)]
    ranked = {f"q{n}": rng.choices(items, k=rng.randint(1, 40)) for n in range(25)}
    truth = {
        f"q{n}": {
            i: rng.choice([0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
            for i in rng.sample(items, rng.randint(1, 20))
        }
        for n in range(22)
    }
    check(spark, ranked, truth, (1, 3, 10), (0.5, 1.0, 2.0))


def test_one_long_list_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = random.Random(5)
    items = [f"i{n}" for n in range(300)]
    ranked = {"hot": rng.sample(items, 300), "cold": items[:4]}
    truth = {q: {i: float(rng.randint(0, 3)) for i in items[::2]} for q in ranked}
    check(spark, ranked, truth, (5,), (1.0, 2.0))


def test_nothing_relevant_and_queries_without_results(spark):
    r, t = frames(spark, {"q": ["a"]}, {"q": {"a": 0.0}, "empty": {"a": 2.0}})
    asked = spark.createDataFrame([("q",), ("empty",), ("unjudged",)], "query_id string")
    rows = M.evaluate(r, t, (3,), queries=asked)
    got = {(x.query_id, x.metric): (x.value, x.valid) for x in rows.collect()}
    assert got[("q", "recall")] == got[("q", "map")] == (1.0, True)
    assert got[("q", "ndcg")] == (0.0, False)
    assert got[("empty", "recall")] == got[("empty", "mrr")] == (0.0, True)
    assert got[("empty", "precision")] == (0.0, False)
    assert not any(q == "unjudged" for q, _ in got)
    mean = {x.metric: (x.value, x.queries) for x in M.averages(rows, (3,)).collect()}
    assert mean["precision"] == (0.0, 1) and mean["recall"] == (0.5, 2)
    assert mean["ndcg"] == (0.0, 1)


def test_no_results_at_all(spark):
    r, t = frames(spark, {"x": ["a"]}, {"y": {"a": 1.0}})
    mean = M.averages(M.evaluate(r, t, (3,)), (3,)).collect()
    assert len(mean) == 8 and all(x.value == 0.0 and x.queries == 0 for x in mean)


def test_identical_labels_give_ari_one(spark):
    items = [f"i{n}" for n in range(10)]
    truth = {"q": {i: (1.0 if n < 5 else 2.0) for n, i in enumerate(items)}}
    rows = M.evaluate(*frames(spark, {"q": items}, truth), (3,), metrics=("ari", "nmi"))
    assert [r.value for r in rows.collect()] == pytest.approx([1.0, 1.0])


def test_irrelevant_tail_keeps_mrr(spark):
    truth = {"a": {"x": 1.0}, "b": {"x": 1.0}}
    ranked = {"a": ["y", "x"], "b": ["y", "x", "z", "w"]}
    rows = M.evaluate(*frames(spark, ranked, truth), (3,), metrics=("mrr",)).collect()
    assert {r.value for r in rows} == {0.5}


def test_distinct_items(spark):
    r, t = frames(spark, {"q": ["a", "a", "b"]}, {"q": {"a": 1.0, "b": 1.0}})
    assert M.judge(r, t, distinct_items=True).count() == 2


def test_best_threshold(spark):
    ranked = {"q": ["a", "b", "c"]}
    truth = {"q": {"a": 2.0, "b": 0.6, "c": 0.0, "d": 0.6}}
    names = ("precision", "recall")
    rows = M.evaluate(*frames(spark, ranked, truth), (3,), (0.5, 1.0, 2.0), names)
    mean = M.averages(rows, (3,), (0.5, 1.0, 2.0), names)
    best = M.best_threshold(mean, (3,)).first()
    assert best.threshold == 0.5 and best.f1 == pytest.approx(2 / 3)
    none = M.evaluate(*frames(spark, {"q": ["c"]}, {"q": {"a": 9.0}}), (3,), (0.5, 1.0), names)
    assert M.best_threshold(M.averages(none, (3,), (0.5, 1.0), names), (3,)).first()[0] == 1.0


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        M.evaluate(*frames(spark, {"q": ["a"]}, {"q": {"a": 1.0}}), metrics=("f2",))
