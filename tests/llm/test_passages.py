"""Repeated passages by units and by the sparse suffix array."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import repeated_words

from textmatch.llm import suffix_dedup
from textmatch.llm.spans import cut_spans
from textmatch.llm.substring_dedup import op7_substring_dedup, repeated_passages, units
from textmatch.llm.suffix_dedup import anchors, matches, repeated_spans, word_hashes


def texts(seed, n=60, vocabulary=4000):
    """Documents of random words with passages of other documents inside, some edited."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    pool = [[word() for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            passage = list(rng.choice(pool))
            low = rng.randint(0, 20)
            passage = passage[low : len(passage) - rng.randint(0, 20)]
            if rng.random() < 0.3 and passage:
                passage[rng.randrange(len(passage))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows


def covered(spans):
    out = {}
    for r in spans:
        out.setdefault(r.id, set()).update(range(r.start_word, r.end_word))
    return out


@pytest.mark.parametrize("seed,chunk,most", [(1, 16_384, 4096), (2, 3, 4096), (3, 16_384, 1), (4, 50, 4)])
def test_suffixes_find_every_repeated_window(documents, monkeypatch, seed, chunk, most):
    """Whole, in small chunks, and with the frequent anchors dealt by digests."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = texts(seed)
    got = covered(repeated_spans(documents(rows)).collect())
    want = repeated_words(rows)
    assert {i: w for i, w in want.items() if w} == got


def test_suffixes_in_repeating_text(documents):
    rows = [(1, "a b " * 200), (2, "x " * 49), (3, "x " * 49), (4, "x " * 51 + "y")]
    got = covered(repeated_spans(documents(rows)).collect())
    want = {i: w for i, w in repeated_words(rows).items() if w}
    assert got == want


def test_blocks_and_neighbours(documents, monkeypatch):
    """One passage in many documents with other surroundings, dealt in blocks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(str(rng.random()) for _ in range(30))} {passage} {rng.random()}") for i in range(120)]
    got = covered(repeated_spans(documents(rows)).collect())
    assert set(got) >= set(range(1, 120)) - {0}
    assert all(w == set(range(30, 100)) for w in got.values())


@pytest.mark.parametrize("seed", range(5))
def test_matches_equal_all_pairs_of_suffixes(seed):
    """Words of one letter each on both sides of a few anchors, compared pair by pair."""
    rng = random.Random(seed)
    reach = suffix_dedup.REACH
    side = lambda: bytes(rng.choice(b"ab") if rng.random() < 0.08 else 97 for _ in range(rng.choice([reach, reach, 9])))
    rows = sorted((rng.randrange(3), side(), side(), rng.randrange(10**6), n) for n in range(60))
    wide = lambda x: b"".join(b"\0" * 7 + bytes([c]) for c in x)
    keys, ids, at = (np.array([r[c] for r in rows], np.int64) for c in (0, 3, 4))
    right, left = (pa.array([wide(r[c]) for r in rows], pa.binary()) for c in (1, 2))
    got = {}
    for row, head, low, high in zip(*matches(ids, at, keys, right, left)):
        assert (ids[head], at[head]) < (ids[row], at[row])
        got.setdefault(row, set()).update(range(low, high + 1))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = {}
    for i, a in enumerate(rows):
        for b in rows:
            if a[0] == b[0] and (b[3], b[4]) < (a[3], a[4]):
                reached = range(reach - common(a[2], b[2]), common(a[1], b[1]) + 1)
                want.setdefault(i, set()).update(reached)
    assert got == {i: r for i, r in want.items() if r}


def test_very_long_texts(documents):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[1000:150_000])), (3, "y " * 300_000)]
    got = covered(repeated_spans(documents(rows)).collect())
    assert got[2] == set(range(1, 149_001)) and got[3] == set(range(1, 300_000)) and 1 not in got


def test_a_common_phrase_with_many_surroundings(documents):
    """Documents that share words beyond a phrase of all are far apart in any order by one side."""
    rng = random.Random(7)
    some = lambda n: " ".join(f"r{rng.random()}" for _ in range(n))
    sides = [[some(7) for _ in range(10)] for _ in range(2)]
    # A phrase whose least run is the anchor of the windows around it, whatever the other words.
    keys = lambda text: set(anchors(word_hashes(text.encode()))[1].tolist())
    phrase = next(p for p in (some(40) for _ in range(10_000)) if set.intersection(*(keys(f"{a} {p} {b}") for a, b in zip(*sides))))
    rows = [(i, " ".join([some(30), rng.choice(sides[0]), phrase, rng.choice(sides[1]), some(30)])) for i in range(400)]
    assert covered(repeated_spans(documents(rows)).collect()) == {i: w for i, w in repeated_words(rows).items() if w}


def test_the_source_is_that_of_the_longest_passage(documents):
    rng = random.Random(8)
    some = lambda n: [f"r{rng.random()}" for _ in range(n)]
    a, b = some(60), some(90)
    rows = [(1, some(20) + a), (2, some(5) + b + some(9)), (3, some(3) + a + b)]
    found = repeated_spans(documents([(i, " ".join(words)) for i, words in rows])).collect()
    assert [tuple(r) for r in found] == [(3, 3, 153, 2)]


def test_shared_windows_share_an_anchor():
    rng = random.Random(6)
    passage = [str(rng.random()) for _ in range(suffix_dedup.MIN_WORDS)]
    for _ in range(50):
        found = []
        for _ in range(2):
            left, right = ([str(rng.random()) for _ in range(rng.randint(0, 60))] for _ in range(2))
            words = word_hashes(" ".join(left + passage + right).encode())
            at, keys = anchors(words)
            inside = (at >= len(left)) & (at + suffix_dedup.ANCHOR <= len(left) + len(passage))
            found.append(set(keys[inside].tolist()))
        assert found[0] & found[1]
    assert len(anchors(np.empty(0, np.uint64))[0]) == 0


def test_suffix_edges(documents):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text), (3, text), (9, text.upper()), (4, None), (5, ""), (6, " \n "), (None, text), (7, "short")]
    got = {(r.id, r.start_word, r.end_word, r.first_id) for r in repeated_spans(documents(rows)).collect()}
    assert got == {(9, 0, 60, 3)}
    assert repeated_spans(documents([])).count() == 0
    docs = documents([(1, text), (2, text)], extra=["id", "at", "key", "content"])
    assert [tuple(r) for r in repeated_spans(docs).collect()] == [(2, 0, 60, 1)]


def plain_units(rows, min_words):
    """(id, start, end, words, first id) by dictionaries."""
    first = {}
    for i, text in sorted(rows):
        for at, u in enumerate(units(text)):
            first.setdefault(u[0], (i, at))
    out = set()
    for i, text in rows:
        run = source = None
        for at, (digest, start, end, words) in enumerate([*units(text), (None, 0, 0, 0)]):
            there = first.get(digest)
            if there == (i, at):
                there = None
            if run and there and there[0] == source[0] and there[1] - source[1] in (0, 1):
                run = [run[0], end, run[2] + words, run[3]]
            else:
                if run and run[2] >= min_words:
                    out.add((i, run[0], run[1], run[2], run[3]))
                run = [start, end, words, there[0]] if there else None
            source = there
    return out


@pytest.mark.parametrize("min_words", [1, 12])
def test_units_equal_the_plain_rule(documents, min_words):
    rng = random.Random(4)
    sentences = [" ".join(f"s{rng.randrange(900)}" for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", "...", ""]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    found = repeated_passages(documents(rows), min_words=min_words).collect()
    assert {(r.id, r.start, r.end, r.n_words, r.first_id) for r in found} == plain_units(rows, min_words)


def pair_units(rows, min_words):
    """(id, start, end, words, first id) by dictionaries of units and neighbours."""
    first, pairs = {}, {}
    for i, text in sorted(rows):
        cut = [u[0] for u in units(text)]
        for at, digest in enumerate(cut):
            first.setdefault(digest, (i, at))
            pairs.setdefault(tuple(cut[at : at + 2]), (i, at))
    out = set()
    for i, text in rows:
        cut, runs = units(text), []
        for at, (digest, start, end, words) in enumerate(cut):
            there = first[digest]
            if there == (i, at):
                continue
            near = at and runs and runs[-1][-1] == at - 1
            before = first[cut[at - 1][0]] if near else None
            parts = [[words, there[0]]]
            if near and before[0] == there[0] and there[1] - before[1] in (0, 1):
                parts = runs[-1][3]
                parts[-1][0] += words
                runs[-1][1:] = [end, runs[-1][2] + words, parts, at]
            elif near and pairs[cut[at - 1][0], digest] != (i, at - 1):
                runs[-1][1:] = [end, runs[-1][2] + words, runs[-1][3] + parts, at]
            else:
                runs.append([start, end, words, parts, at])
        out |= {(i, *r[:3], max(r[3], key=lambda p: p[0])[1]) for r in runs if r[2] >= min_words}
    return out


@pytest.mark.parametrize("min_words", [1, 12])
def test_pairs_equal_the_plain_rule(documents, min_words):
    rng = random.Random(9)
    sentences = [" ".join(f"s{rng.randrange(900)}" for _ in range(rng.randint(1, 9))) + "." for _ in range(25)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    found = repeated_passages(documents(rows), min_words=min_words, by_pairs=True).collect()
    assert {(r.id, r.start, r.end, r.n_words, r.first_id) for r in found} == pair_units(rows, min_words)


def test_a_copied_passage_is_whole_though_a_sentence_is_older(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(18)) + "." for x in "abc")
    rows = [(1, f"Old. {b} Words."), (2, f"Here. {a} {b} {c} More."), (3, f"There. {a} {b} {c} Else."), (4, f"New. {b} End.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in op7_substring_dedup(spark, str(tmp_path)).collect()]
    assert found == [(3, 7, 7 + len(f"{a} {b} {c}"), 3, 54, 2)]


def test_pairs_in_texts_without_an_id(documents):
    rows = [(None, "one two. three four. one two. three four."), (None, "x")]
    found = repeated_passages(documents(rows), min_words=1, by_pairs=True).collect()
    assert sum(r.n_words for r in found) == 4


def test_units_and_their_offsets():
    text = "  One two. Three 3.14 four!  Five\n\n...\nsix seven"
    cut = [text[s:e] for _, s, e, _ in units(text)]
    assert cut == ["One two.", "Three 3.14 four!", "Five", "...", "six seven"]
    assert [text[s:e] for _, s, e, _ in units(text, sentences=False)] == [text.split("\n")[0].strip(), "...", "six seven"]
    assert units("A  b.")[0][0] == units("a b.")[0][0] and units(None) == units("") == units(" \n") == []


def test_a_passage_inside_a_line_is_found_and_cut(documents):
    passage = "This is the shared passage of some length here. It has two sentences, and ends so."
    rows = [(1, f"Begin.\n{passage}\nEnd."), (2, f"other words before. {passage} And after."), (3, "Begin.\nclean")]
    docs = documents(rows)
    found = repeated_passages(docs, min_words=10)
    assert [(r.id, r.first_id) for r in found.collect()] == [(2, 1)]
    left = {r.doc_id: r.text for r in cut_spans(docs, found.withColumnRenamed("id", "doc_id")).collect()}
    assert left[2] == "other words before.  And after." and left[1] == rows[0][1] and left[3] == rows[2][1]


def test_unit_edges(documents):
    line = "many words are in this line that is here twice and more often than that in truth yes"
    rows = [(2, line), (2, line), (1, line), (None, line), (4, None), (5, ""), (6, f"{line}\n{line}")]
    found = repeated_passages(documents(rows, extra=["digest", "first", "at"]), min_words=10).collect()
    assert {(r.id, r.first_id, r.n_units) for r in found} == {(None, 1, 1), (2, 1, 1), (6, 1, 2)}
    assert repeated_passages(documents([])).count() == 0
