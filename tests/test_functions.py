"""Scalar functions against literal vectors and properties."""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmatch.config import EngineConfig
from textmatch.functions import text as X
from textmatch.functions.titles import normalize_title, standardize_title
from textmatch.functions.tokens import all_words, count_terms, ngrams, spaced_words, terms, words
from textmatch.functions.vectors import cosine, l2_normalize
from textmatch.operators import tfidf
from textmatch.operators.chunking import chunk_text


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_clean_text(spark):
    given = [None, "", "  a\t b!  ", 'it\'s "ok"', "a  b", "!!", "x\x1cy\x85z"]
    assert column(spark, given, X.clean_text) == ["", "", "a b", "its ok", "a b", "", "x y z"]


FULL = {
    "": "Unknown Title",
    None: "Unknown Title",
    "Senior Software Engineer": "Software Engineer",
    "Sr. Data Analyst": "Data Analyst",
    "Front-End Developer": "Frontend Developer",
    "Full Stack Engineer": "Fullstack Engineer",
    "DevOps Engineer | Cloud": "DevOps Engineer",
    "UI/UX Designer": "UI / UX Designer",
    "Sales and Marketing Manager": "Sales / Marketing Manager",
    "Manager, Operations": "Manager",
    "Developer (Remote)": "Developer",
    "Freelance Web Developer": "Web Developer",
    "Analyst; Clerk": "Analyst",
    "4-NOT SPECIFIED": "-not Specified",
    "Intern": "",
    "Internal Auditor": "Al Auditor",
    "2 Internal Auditor": "Internal Auditor",
    "Manager - Sales": "Manager Sales",
    "Leadership Coach": "Ership Coach",
    "MySQL DevOps Admin": "MySQL DevOps Admin",
    "DevOps-Engineer": "DevOps Engineer",
    "fronten d backen d": "Frontend Backend",
    "Éand and b": "Éand / B",
    "Data Senior Analyst": "Data Analyst",
    "ßung clerk": "Ssung Clerk",
}


def test_standardize_title_full(spark):
    assert column(spark, list(FULL), standardize_title) == list(FULL.values())


def test_standardize_title_lite(spark):
    given = ["Senior Software Engineer", "Freelance Web Developer", "Front-End Dev", "A - B"]
    expected = ["Senior Software Engineer", "Freelance Web Developer", "Frontend Dev", "A - B"]
    assert column(spark, given, lambda c: standardize_title(c, "lite")) == expected


def test_standardize_title_word_boundary(spark):
    given = ["Internal Auditor", "Intern Auditor", "Sr. Analyst"]
    expected = ["Internal Auditor", "Auditor", "Analyst"]
    got = column(spark, given, lambda c: standardize_title(c, word_boundary=True))
    assert got == expected


def test_unknown_profile():
    with pytest.raises(ValueError):
        standardize_title(None, "other")


def test_normalize_title(spark):
    given = ["UI Dev", "Sales and Marketing Manager", None, "Front-End Eng."]
    expected = [
        "user interface developer",
        "sales marketing manager",
        "",
        "frontend engineer",
    ]
    assert column(spark, given, normalize_title) == expected


def test_paths(spark):
    given = ["/a/b.c/x.y.PDF", "/a.d/b", "file:/q/cv.docx"]
    assert column(spark, given, X.base_stem) == ["x.y", "b", "cv"]
    assert column(spark, given, X.extension) == [".pdf", "", ".docx"]
    assert column(spark, given, X.base_name) == ["x.y.PDF", "b", "cv.docx"]


def test_ellipsis_and_preview(spark):
    assert column(spark, ["a" * 5, "ab"], lambda c: X.ellipsis(c, 3)) == ["aaa...", "ab"]
    assert column(spark, [" a\nb "], X.preview) == ["a b"]


def test_tokens(spark):
    got = column(spark, ["The quick Élan, a quick élan x"], terms)[0]
    assert got == ["quick", "élan", "quick", "élan", "quick élan", "élan quick", "quick élan"]
    counts = column(spark, ["quick Élan quick élan", ""], lambda c: count_terms(terms(c)))
    expected = {"quick": 2, "élan": 2, "quick élan": 2, "élan quick": 1}
    assert {r.term: r.tf for r in counts[0]} == expected
    assert counts[1] == []
    assert column(spark, ["the cat"], lambda c: words(c, [])) == [["the", "cat"]]
    assert column(spark, ["a1 b2 c3"], lambda c: ngrams(words(c), 3, 3)) == [["a1 b2 c3"]]


def test_spaced_words_cut_at_blanks_are_the_words(spark):
    """for every character of the first plane and some of others, beside letters and alone."""
    marks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001d400", "\U00010400", "\U0001f600"]
    given = [f"Ab{m}cd {m}{m} e{m} {m}f,,g" for m in marks] + ["", None, " x ", "\U0001d400"]
    found = column(spark, given, spaced_words)
    cut = [None if t is None else [w for w in t.split(" ") if len(w) > 1] for t in found]
    assert cut == column(spark, given, all_words)
    lists = tfidf._cut(pa.array(found, pa.string()))
    assert lists.to_pylist() == [w or [] for w in cut]
    nested = tfidf._cut_lists(pa.array([found[:3], None, [], found[3:5]], pa.list_(pa.string())))
    assert nested.to_pylist() == [cut[:3], [], [], cut[3:5]]


def test_white_space_is_found_among_all_characters(spark):
    marks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    given = [t for m in marks for t in (f"a{m}b", f"a {m}b", f"{m} ")]
    plain = lambda c: F.trim(F.regexp_replace(c, f"{X.WS}+", " "))
    assert column(spark, given, X.collapse) == column(spark, given, plain)


def test_strip_takes_white_space_of_any_kind(spark):
    marks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    given = [t for m in marks for t in (f"{m}a{m} b {m}", f" {m}", f"\n{m}x\r\n")] + ["", None]
    plain = lambda c: F.regexp_replace(c, f"^{X.WS}+|{X.WS}+$", "")
    assert column(spark, given, X.strip) == column(spark, given, plain)


def loop_chunks(text, size=512, overlap=50):
    """The rule, written as a plain loop over characters."""
    window, back = size * 4, overlap * 4
    if len(text) <= window:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + window
        if end < len(text):
            spaces = [i for i in range(start, end) if text[i] == " "]
            if spaces and spaces[-1] > start:
                end = spaces[-1]
        if text[start:end].strip():
            out.append(text[start:end].strip())
        start = max(start + 1, end - back)
    return out


def test_chunk_lengths_without_blanks(spark):
    given = ["x" * n for n in (0, 2048, 2100, 3800, 4000)]
    got = column(spark, given, chunk_text)
    assert [[len(c) for c in row] for row in got] == [
        [0], [2048], [2048, 252], [2048, 1952, 104], [2048, 2048, 304],
    ]


def test_chunks_match_the_rule(spark):
    rng = random.Random(7)
    given = [
        "".join(rng.choice("abcdé   ") for _ in range(rng.randint(0, 900)))
        for _ in range(60)
    ]
    cfg = EngineConfig(chunk_size=25, chunk_overlap=5)
    got = column(spark, given, lambda c: chunk_text(c, cfg))
    for text, pieces in zip(given, got):
        assert pieces == loop_chunks(text, 25, 5)
        assert all(len(p) <= 100 for p in pieces) or len(text) <= 100


def test_vectors(spark):
    row = spark.range(1).select(
        l2_normalize(F.expr("array(3.0D, 4.0D)")).alias("unit"),
        l2_normalize(F.expr("array(0.0D, 0.0D)")).alias("zero"),
        cosine(F.expr("array(0.0D)"), F.expr("array(3.0D)")).alias("none"),
        cosine(F.expr("array(1.0D, 1.0D)"), F.expr("array(2.0D, 0.0D)")).alias("half"),
    ).first()
    assert row.unit == [0.6, 0.8] and row.zero == [0.0, 0.0] and row.none == 0.0
    assert math.isclose(row.half, math.sqrt(0.5))


def test_white_space_of_any_kind_becomes_one_blank(spark):
    rng = random.Random(3)
    marks = [" ", " ", "  ", "\n", "\t ", "\xa0", "\u2003", "\u3000", "\x1c", "\x85", "a", "Z", "~", "!", "\xe9", "'", "\x7f", "\u200b"]
    given = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    spaces = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    want = [re.sub(f"[{spaces}]+", " ", re.sub("['\"!]", "", t)).strip(" ") for t in given]
    assert column(spark, given, X.clean_text) == want
