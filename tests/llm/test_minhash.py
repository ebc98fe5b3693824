from __future__ import annotations

import random

import numpy as np
import pytest
from brute import components, shingles

from textmatch.llm.minhash import linked, near_duplicates, signature
from textmatch.llm.minhash import shingles as hashed


def edited(rng, words, share):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{rng.randrange(50)}x{rng.randrange(40)}" for _ in range(rng.randint(3, 160))]
        for _ in range(size):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(documents, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One TWO")]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect()}
    want = components(rows)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}


def test_a_large_group_that_no_representative_covers(documents):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.05])))) for i in range(160)]
    got = {r.id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert got == components(rows)


def test_repeated_rows_null_ids_and_ties(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"),
            (None, "alone here"), (7, "other words in a row here"), (7, "a b c d e f")]
    got = sorted(
        ((r.id, r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect()),
        key=str,
    )
    want = [(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (7, 2, 3)]
    assert [g for g in got if g[0] != 7] == sorted([w for w in want if w[0] != 7], key=str)
    assert sorted(g[1] for g in got if g[0] == 7) == [2, 2]


def test_empty_table_and_clashing_names(documents):
    assert near_duplicates(documents([])).count() == 0
    docs = documents([(1, "a b"), (2, "a b")], extra=["id", "digest", "component"])
    assert {(r.id, r.component_id) for r in near_duplicates(docs).collect()} == {(1, 1), (2, 1)}


def test_signature_estimates_similarity():
    rng = random.Random(5)
    base = [f"v{i}" for i in range(400)]
    for share in (0.0, 0.02, 0.05, 0.1):
        a, b = " ".join(base), " ".join(edited(rng, base, share))
        x, y = shingles(a), shingles(b)
        got = float(np.mean(signature(hashed(a.encode())) == signature(hashed(b.encode()))))
        assert abs(got - len(x & y) / len(x | y)) < 0.13


def test_cells_find_a_link_to_each_other_component():
    sets = [list(range(0, 100)), list(range(5, 105)), list(range(200, 300)), list(range(90, 190))]
    members = [(i, i, np.array(s)) for i, s in enumerate(sets)]
    found = {frozenset(x) for x in linked(members, 75)}
    assert found == {frozenset((0, 1))}
    assert linked(members[:1], 75) == [] and linked([], 75) == []
