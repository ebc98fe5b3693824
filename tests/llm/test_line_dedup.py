from __future__ import annotations

import random
from collections import defaultdict

from textmatch.llm.line_dedup import line_dedup


def plain(rows, limit):
    """{row number: (lines, removed, text)} by exact counts."""
    normal = lambda x: " ".join(x.lower().split())
    sites, texts, first = defaultdict(set), defaultdict(set), {}
    for i, text, _, source in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if normal(line):
                sites[normal(line)].add(source)
                texts[normal(line)].add(text)
                place = ((i is not None, i or 0), pos)
                first[normal(line)] = min(first.get(normal(line), place), place)
    out = []
    for i, text, _, source in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        kept = []
        for pos, line in enumerate(text.split("\n")):
            key = normal(line)
            common = key and len(sites[key]) >= limit and len(texts[key]) >= limit
            if not common or first[key] == ((i is not None, i or 0), pos):
                kept.append(line)
        total = len(text.split("\n"))
        out.append((i, total, total - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(docs, limit):
    found = line_dedup(docs, min_sites=limit).select("doc_id", "n_lines", "n_removed", "text")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_exact_counts(documents):
    rng = random.Random(1)
    shared = [f"shared line {i}" for i in range(12)]
    rows = []
    for i in range(240):
        lines = [f"own {i} {j}" for j in range(rng.randint(0, 4))]
        lines += [rng.choice(["", " "]) + rng.choice([s, s.upper(), s.replace(" ", "  ")])
                  for s in rng.sample(shared, rng.randint(0, 5))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice([None, *[f"s{k}" for k in range(i % 14 + 1)]])))
    for limit in (2, 6, 11):
        assert run(documents(rows), limit) == plain(rows, limit)


def test_a_page_copied_to_many_sites_stays_whole(documents):
    rows = [(i, "first line\nsecond line", "en", f"s{i}") for i in range(30)]
    assert all(n == 0 for _, _, n, _ in run(documents(rows), 10))


def test_edges(documents):
    rows = [(i, f"menu\n\nown {i}", "en", f"s{i}") for i in range(6)]
    rows += [(0, "menu\n\nown 0", "en", "s0"), (None, "Menu\nx", "en", None), (9, None, None, None), (10, "", "en", "s")]
    assert run(documents(rows, extra=["line", "first", "pos", "n_lines", "gone"]), 5) == plain(rows, 5)
    assert run(documents([]), 5) == []


def test_very_long_text(documents):
    text = "\n".join(f"line {i}" for i in range(30_000)) + "\nmenu"
    rows = [(i, f"menu\n{i}", "en", f"s{i}") for i in range(5)] + [(7, text, "en", "s7")]
    assert run(documents(rows), 5) == plain(rows, 5)


def test_only_spark_functions(documents):
    plan = line_dedup(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
