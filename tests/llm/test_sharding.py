from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pytest

from textmatch.llm import sharding
from textmatch.llm.sharding import pack, pack_even, shard


def best_fit(sizes, capacity):
    """Best fit decreasing with a sorted list."""
    bins, out, opened = [], {}, 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(bins, (sizes[i], -1))
        if at == len(bins):
            room, b = capacity, opened
            opened += 1
        else:
            room, b = bins.pop(at)
        out[i] = b
        insort(bins, (room - sizes[i], b))
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(5))
def test_the_tree_packs_as_a_sorted_list_does(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 400))]
    assert pack(sizes, 120) == best_fit(sizes, 120)
    assert pack([130], 120) is None and pack([], 5) == []


def test_even_packing_is_near_the_mean():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(5000)]
    load = defaultdict(int)
    for s, b in zip(sizes, pack_even(sizes, 40)):
        load[b] += s
    assert len(load) == 40 and max(load.values()) <= 1.01 * sum(sizes) / 40
    assert sorted(pack_even([5, 5, 5], 2)) in ([0, 0, 1], [0, 1, 1])
    assert len(set(pack_even([900, 10, 10, 10, 9, 9, 9, 1], 4))) == 4
    assert pack_even([], 3) == [] and pack_even([7], 3) == [0]


def check(rows, found, shards):
    assert sorted(((str(r.id), r.size, r.crc) for r in found)) == sorted(
        (str(i), 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    load = defaultdict(int)
    for r in found:
        load[r.shard] += r.size
    return load


def test_shards_are_even_and_groups_stay_together(documents):
    rng = random.Random(2)
    pool = ["x" * rng.randint(0, 300) + str(k) for k in range(500)]
    rows = [(i, rng.choice(pool)) for i in range(1500)] + [(None, "null id"), (5007, None), (5008, None), (5009, "")]
    found = shard(documents(rows, extra=["unit", "block", "size"]), 10).collect()
    load = check(rows, found, 10)
    assert max(load.values()) <= 1.02 * sum(load.values()) / 10
    text = dict(rows)
    where = defaultdict(set)
    for r in found:
        where[text[r.id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_larger_than_a_shard_is_dealt(documents):
    rows = [(i, "the same long text " * 5) for i in range(600)] + [(1000 + i, f"other {i}") for i in range(900)]
    load = check(rows, shard(documents(rows), 8).collect(), 8)
    assert max(load.values()) <= 1.1 * sum(load.values()) / 8


def test_many_small_groups_share_units(documents, monkeypatch):
    monkeypatch.setattr(sharding, "UNITS", 64)
    monkeypatch.setattr(sharding, "BLOCKS", 16)
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(900)}") for i in range(2000)] + [(5000 + i, "") for i in range(700)]
    load = check(rows, shard(documents(rows), 4).collect(), 4)
    assert max(load.values()) <= 1.15 * sum(load.values()) / 4


def test_fixed_capacity_opens_few_shards(documents):
    rows = [(i, "y" * (i % 50) + str(i)) for i in range(300)]
    found = shard(documents(rows), None, capacity=1000).collect()
    load = check(rows, found, 300)
    assert max(load.values()) <= 1000 and len(load) <= -(-sum(load.values()) // 1000) + 1


def test_same_result_twice_and_empty(documents):
    rows = [(i % 40, f"t{i % 13}") for i in range(200)]
    a, b = (sorted(map(tuple, shard(documents(rows), 5).collect())) for _ in range(2))
    assert a == b
    assert shard(documents([]), 5).count() == 0
    assert len(shard(documents([(1, "a")]), 40).collect()) == 1
