"""The queries that SQL can't express, by name and over whole tables, against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from brute import repeated_words

from textmatch.llm.html_extract import extract, fit_trees, training_rows
from textmatch.llm.pieces import load_pieces
from textmatch.llm.registry import REGISTRY
from textmatch.llm.sentencepiece import Encoder


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_pieces())


def test_token_counts(spark, sf_dir, texts, encoder):
    rows = REGISTRY["op4_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(encoder.encode(t)) for i, t in texts.items()}


def test_sentencepiece(spark, sf_dir, texts, encoder):
    rows = REGISTRY["op5_sentencepiece"](spark, sf_dir).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: encoder.encode(t).tolist() for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert all(encoder.decode(r.token_ids) == texts[r.doc_id] for r in rows)


def test_suffix_array(spark, sf_dir, texts):
    got = defaultdict(set)
    for r in REGISTRY["op10_suffix_array"](spark, sf_dir).collect():
        assert r.n_words == r.end_word - r.start_word
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == {i: w for i, w in repeated_words(texts.items()).items() if w}


def test_sharding(spark, sf_dir, texts):
    rows = REGISTRY["op9_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "bytes")
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) <= max(1.1 * sum(load.values()) / 40, max(r.size for r in rows))


def test_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in REGISTRY["op8_html_extraction"](spark, sf_dir).collect()}
    assert len(rows) == pages.count()
    again = extract(pages, fit_trees(training_rows(pages.select("page_id", "url", "html"))))
    assert {r.page_id: r.text for r in again.select("page_id", "text").collect()} == {i: r.text for i, r in rows.items()}
    assert all(r.n_chars == len(r.text) and "<script" not in r.text for r in rows.values())
    assert sum(bool(r.text) for r in rows.values()) > 0.9 * len(rows)
