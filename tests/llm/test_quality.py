from __future__ import annotations

import random
from collections import Counter

import pytest
from brute import WORD

from textmatch.llm.quality import (
    RATES,
    counts_of,
    quality_filter,
    sketches,
    text_counts,
    thresholds,
)


def plain_counts(text):
    words = WORD.findall(text)
    runs = list(zip(words, words[1:], words[2:]))
    times = Counter(runs)
    inside = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in "".join(words)), len(lines),
        len(lines) - len(set(lines)), len(inside),
    )


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_the_plain_rule(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "é", "日本", "#x", "<|>", "c d", "\U0001f600"]
    for _ in range(150):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
        assert counts_of(text.encode()) == plain_counts(text)
    assert counts_of(b"") == (0,) * 6


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_junk_goes_and_clean_documents_stay(documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, " | ".join(prose(rng, 90).split()), "en", "s1") for i in range(40)]
    rows += [(2000, "word", "en", "s1"), (2001, "a b c " * 60, "en", "s0")]
    kept = {r.doc_id for r in quality_filter(documents(rows)).where("kept").collect()}
    assert kept == set(range(300))


def test_thresholds_adapt_to_a_source(documents):
    """A source whose every text has symbols sets its own limit."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 90), "en", "plain") for i in range(80)]
    rows += [(500 + i, prose(rng, 90).replace(" ", " # ", 30), "en", "code") for i in range(80)]
    rows += [(900, prose(rng, 90).replace(" ", " # ", 30), "en", "plain")]
    kept = {r.doc_id for r in quality_filter(documents(rows)).where("kept").collect()}
    assert kept == set(range(80)) | set(range(500, 580))


def test_sketches_merge_and_small_groups_borrow(documents):
    rng = random.Random(10)
    rows = [(i, prose(rng, 60), "en", f"s{i % 4}") for i in range(100)] + [(200, prose(rng, 60), "xx", "lone")]
    docs = documents(rows)
    whole = sketches(text_counts(docs))
    parts = sketches(text_counts(docs.where("doc_id % 2 = 0"))).union(sketches(text_counts(docs.where("doc_id % 2 = 1"))))
    merged = parts.groupBy("lang", "source", "rate", "value").sum("rows")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    limits = {r.t_lang: r for r in thresholds(whole).collect()}
    assert limits["xx"].word_length_high is not None and set(limits) == {"en", "xx"}


def test_edges(documents):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "x " * 5, "en", "s"), (4, "w " * 100_000, None, "s")]
    rows += [(5, prose(random.Random(1), 80), None, None)] * 2
    found = quality_filter(documents(rows, extra=["kept", "n_words", "rate", "rows"])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in found) == sorted(
        [("1", 0, False), ("2", 0, False), ("None", 5, False), ("4", 100_000, False), ("5", 80, True), ("5", 80, True)]
    )
    assert quality_filter(documents([])).count() == 0
    assert len(RATES) == 4
