"""Encoding against the installed library (given the same pieces and scores) and all spellings."""

from __future__ import annotations

import random
import struct

import pytest

from textmatch.llm.pieces import MARK, MODEL, Pieces, load_pieces
from textmatch.llm.sentencepiece import DoubleArray, Encoder, decode, encode, encode_and_check
from textmatch.llm.token_counts import CountingTrie, token_counts, totals

TEXTS = [
    "", " ", "  two  blanks ", "Hello, world!", "a\nb\n\nc", "tab\there", "naïve café ßtraße",
    "日本語とeмиx", "\U0001f600 emoji \U0001f600\U0001f600", "x" * 300, "3.14e-5, v2.0_beta",
    "_{a} »b«, “q”. ²x", "\x00\x01 control", "á́ combining",
]


def field(number, kind, body):
    head = (number << 3) | kind
    out = b""
    while True:
        out += bytes([head & 0x7F | (0x80 if head > 0x7F else 0)])
        head >>= 7
        if not head:
            break
    if kind == 2:
        size, raw = len(body), b""
        while True:
            raw += bytes([size & 0x7F | (0x80 if size > 0x7F else 0)])
            size >>= 7
            if not size:
                break
        return out + raw + body
    return out + body


def model_bytes(pieces: Pieces) -> bytes:
    """A unigram model file of the same pieces, ids and scores, for the library to read."""
    names = {i: (p, s, 1) for p, (i, s) in pieces.scores.items()}
    names |= {i: (f"<0x{b:02X}>", 0.0, 6) for b, i in enumerate(pieces.byte_ids)}
    names |= {0: ("<unk>", 0.0, 2), 1: ("<s>", 0.0, 3), 2: ("</s>", 0.0, 3)}
    out = b""
    for i in range(pieces.size):
        p, s, kind = names[i]
        body = field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([kind]))
        out += field(1, 2, body)
    size = pieces.size
    varint = b""
    while size:
        varint += bytes([size & 0x7F | (0x80 if size > 0x7F else 0)])
        size >>= 7
    trainer = field(3, 0, b"\x01") + field(4, 0, varint) + field(35, 0, b"\x01")
    normalizer = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")
    return out + field(2, 2, trainer) + field(3, 2, normalizer)


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


@pytest.fixture(scope="module")
def encoder(pieces):
    return Encoder(pieces)


@pytest.fixture(scope="module")
def corpus():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()


def score(pieces, encoder, ids):
    named = {i: s for _, (i, s) in pieces.scores.items()}
    return sum(named.get(i, 0.0) for i in ids)


def test_same_as_the_library(pieces, encoder, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(pieces))
    same = total = 0
    for text in TEXTS + corpus:
        if "\x00" in text:  # the library ends a text there
            continue
        ours, theirs = encoder.encode(text).tolist(), library.encode(text)
        if ours != theirs:  # only by the rounding of its scores to 32 bits
            assert abs(score(pieces, encoder, ours) - score(pieces, encoder, theirs)) < 1e-2
        same += ours == theirs
        total += 1
        assert library.decode(ours) == text
    assert same >= 0.9 * total


def test_round_trip(encoder, corpus):
    for text in [*TEXTS, *corpus, f"own {MARK} mark{MARK}{MARK} {MARK}"]:
        assert encoder.decode(encoder.encode(text).tolist()) == text
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(f" \n{MARK}aeth.,é日\U0001f600_1") for _ in range(rng.randint(0, 30)))
        assert encoder.decode(encoder.encode(text).tolist()) == text


def tiny():
    words = ["a", "b", "ab", "ba", "aba", MARK, MARK + "a", MARK + "ab", MARK + MARK, "c.", ".", "c"]
    rng = random.Random(4)
    return Pieces(
        {w: (i, -rng.randint(1, 9) / 4) for i, w in enumerate(words)},
        tuple(range(100, 356)), 356,
    )


def best_by_trying_all(pieces, text):
    """The highest score of any spelling, by recursion over all of them."""
    text = " " + text

    def best(at):
        if at == len(text):
            return 0.0
        found = []
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if MARK not in part and part.replace(" ", MARK) in pieces.scores:
                found.append(pieces.scores[part.replace(" ", MARK)][1] + best(end))
        one = text[at].replace(" ", MARK)
        if text[at] == MARK or one not in pieces.scores:
            found.append(pieces.unknown_score + best(at + 1))
        return max(found)

    return best(0)


def test_best_of_all_spellings():
    pieces = tiny()
    encoder, trie = Encoder(pieces), CountingTrie(pieces)
    rng = random.Random(9)
    named = {i: s for _, (i, s) in pieces.scores.items()}
    for _ in range(400):
        text = "".join(rng.choice(f"ab c.é{MARK}") for _ in range(rng.randint(1, 9)))
        ids = encoder.encode(text).tolist()
        unknown = sum(c == MARK or (c not in pieces.scores and c != " ") for c in text)
        got = sum(named.get(i, 0.0) for i in ids) + unknown * pieces.unknown_score
        assert got == pytest.approx(best_by_trying_all(pieces, text))
        assert encoder.decode(ids) == text
        assert sum(map(trie.count, pieces.pre_tokens(text))) == len(ids)


def test_pieces_that_cross_blanks_forbid_cuts():
    pieces = Pieces({"a": (0, -1.0), MARK: (1, -1.0), f"a{MARK}a": (2, -0.5)}, tuple(range(9, 265)), 300)
    assert pieces.pre_tokens("a a") == [" a a"]
    assert Encoder(pieces).encode("a a").tolist() == [1, 2]


def test_counts_equal_encoded_lengths(pieces, encoder, corpus):
    trie = CountingTrie(pieces)
    for text in [*TEXTS, *corpus, f"{MARK}x {MARK}"]:
        assert sum(map(trie.count, pieces.pre_tokens(text))) == len(encoder.encode(text))


def test_forgetting_changes_nothing(pieces, encoder, corpus, monkeypatch):
    import textmatch.llm.sentencepiece as sp
    import textmatch.llm.token_counts as tc

    monkeypatch.setattr(sp, "REMEMBERED", 50)
    monkeypatch.setattr(tc, "NODES", 80)
    small, trie = Encoder(pieces), CountingTrie(pieces)
    for text in corpus[:20]:
        assert small.encode(text).tolist() == encoder.encode(text).tolist()
        assert sum(map(trie.count, pieces.pre_tokens(text))) == len(encoder.encode(text))


def test_double_array_holds_its_keys():
    rng = random.Random(2)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))) for _ in range(800)})
    trie = DoubleArray.build(keys)
    for i, key in enumerate(keys):
        node = 0
        for byte in key:
            child = trie.base[node] + byte + 1
            assert trie.check[child] == node
            node = child
        assert trie.value[node] == i


def test_tables(spark, documents, pieces):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (4, "x" * 200_000), (4, "x" * 200_000), (None, "a b")]
    docs = documents(rows, extra=["token_ids", "n_tokens", "decoded"])
    encoded = encode(docs, pieces)
    assert encoded.columns.count("token_ids") == 1
    back = decode(encoded, pieces).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back) and len(back) == len(rows)
    checked = {(r.doc_id, r.n_tokens, r.round_trip) for r in encode_and_check(docs, pieces).collect()}
    counted = token_counts(docs, pieces)
    assert {(r.doc_id, r.n_tokens) for r in counted.collect()} == {(i, n or 0) for i, n, _ in checked}
    assert {s for _, n, s in checked} == {True, None}
    assert totals(counted, "lang").first().documents == len(rows)
    assert encode_and_check(documents([]), pieces).count() == 0



def test_the_model_path_is_a_parameter(tmp_path):
    import shutil

    copy = tmp_path / "own.model"
    shutil.copyfile(MODEL, copy)
    assert load_pieces(str(copy)).scores == load_pieces().scores


def test_time_grows_with_the_text(encoder):
    import time

    begin = time.process_time()
    ids = encoder.best_path("abcdefgh" * 100_000)
    assert time.process_time() - begin < 8
    assert encoder.decode(ids) == "abcdefgh" * 100_000
