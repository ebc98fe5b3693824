"""Unigram encoding by Viterbi over a double-array trie of pieces, and its exact inverse.

A text gets one leading blank, blanks become marks, and of all ways to spell it with pieces the
one with the highest sum of log scores is taken (on a tie the path found first, going over
starts and then ends from left to right). A character that no piece covers is spelled as its
UTF-8 bytes, at a fixed penalty; so is a mark that occurs in the text itself, which keeps it
apart from a blank. Decoding therefore gives back every text exactly.

The piece table is read on the driver and broadcast; its size is that of the vocabulary. Rows
don't move. Texts are cut into pre-tokens that no piece can cross, and the best path of recent
ones is remembered up to a fixed number; a forgotten one is worked out again.

Defined results: null gives null, an empty text an empty list. Texts of any length and rows that
repeat are treated alike; an empty table gives no rows. Other columns pass unchanged; one named
as the result is replaced. Ids outside the vocabulary, and special ones, decode to nothing.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import rows_with, table
from textmatch.llm.pieces import MARK, MODEL, Pieces, load_pieces

REMEMBERED = 150_000  # pre-tokens of a generation; two are kept


@dataclass(frozen=True)
class DoubleArray:
    """A byte trie in two arrays: child = base[node] + byte + 1, valid if check[child] == node."""

    base: list[int]
    check: list[int]
    value: list[int]  # index of the piece that ends at a node, or -1

    @classmethod
    def build(cls, keys: list[bytes]) -> DoubleArray:
        """``keys`` must be sorted and distinct."""
        size = 4096
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        # No usable slot before the one is free, none after the other taken. The first usable
        # slot lies beyond every byte, so that no base is negative.
        free, top = 258, 258
        todo = [(0, 0, len(keys), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            if len(keys[low]) == depth:
                value[node] = low
                low += 1
            spans = []
            at = low
            while at < high:
                byte, start = keys[at][depth], at
                while at < high and keys[at][depth] == byte:
                    at += 1
                spans.append((byte + 1, start, at))
            if not spans:
                continue
            first = spans[0][0]
            # Few children go into the first holes, many beyond what is taken.
            slot = free if len(spans) < 2 else max(free, top - 64)
            while True:
                if slot + 257 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if check[slot] < 0 and all(check[slot - first + c] < 0 for c, _, _ in spans):
                    break
                slot += 1
            base[node] = slot - first
            for c, start, end in spans:
                child = base[node] + c
                check[child] = node
                todo.append((child, start, end, depth + 1))
                top = max(top, child)
            while check[free] >= 0:
                free += 1
        return cls(base, check, value)


_NOWHERE = float("-inf")


class Encoder(dict):
    """Pre-token to the bytes of its ids (32-bit). Ask it by ``encoder[pre_token]``."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, bytes] = {}
        keys = sorted(p.encode() for p in pieces.scores)
        self.trie = DoubleArray.build(keys)
        self.longest = max(map(len, keys), default=0)
        entries = [pieces.scores[k.decode()] for k in keys]
        # By node: where its children begin for byte 0, and the score and id that end there.
        self.first = [b + 1 for b in self.trie.base]
        self.ends = [entries[v][1] if v >= 0 else None for v in self.trie.value]
        self.node_ids = [entries[v][0] if v >= 0 else -1 for v in self.trie.value]
        self.singles = {p.encode() for p in pieces.scores if len(p) == 1}
        self.plain = [bytes([b]) in self.singles for b in range(256)]
        self.units: list[bytes] = [b""] * pieces.size
        for piece, (i, _) in pieces.scores.items():
            self.units[i] = piece.replace(MARK, " ").encode()
        for byte, i in enumerate(pieces.byte_ids):
            self.units[i] = bytes([byte])

    def __missing__(self, pre_token: str) -> bytes:
        found = self.older.get(pre_token)
        if found is None:
            found = array("i", self.best_path(pre_token)).tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(pre_token) <= 64:
            self[pre_token] = found
        return found

    def best_path(self, pre_token: str) -> list[int]:
        """The ids of the best spelling of one pre-token."""
        own_mark = MARK.encode()
        data = pre_token.encode()
        if own_mark in data:
            # The byte 0xFF is in no UTF-8 text, so in no piece.
            data = data.replace(own_mark, b"\xff")
        data = data.replace(b" ", own_mark)
        base, check, ends = self.first, self.trie.check, self.ends
        n = len(data)
        best = [_NOWHERE] * (n + 1)
        came, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here == _NOWHERE:  # inside a character
                continue
            node, end = 0, start
            for byte in data[start : start + self.longest]:
                child = base[node] + byte
                if check[child] != node:
                    break
                node = child
                end += 1
                score = ends[node]
                if score is not None:
                    score += here
                    if score > best[end]:
                        best[end], came[end], piece[end] = score, start, node
            lead = data[start]
            if not self.plain[lead]:  # a character that may have no piece
                width = 1 if lead < 0x80 or lead == 0xFF else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if data[start : start + width] not in self.singles:
                    score = here + self.pieces.unknown_score
                    end = start + width
                    if score > best[end]:
                        best[end], came[end], piece[end] = score, start, -1
        out: list[int] = []
        at = n
        while at > 0:
            start, node = came[at], piece[at]
            if node >= 0:
                out.append(self.node_ids[node])
            else:
                spelled = own_mark if data[start:at] == b"\xff" else data[start:at]
                out.extend(self.pieces.byte_ids[b] for b in reversed(spelled))
            at = start
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        found = b"".join(map(self.__getitem__, self.pieces.pre_tokens(text)))
        return np.frombuffer(found, np.int32)

    def decode(self, ids) -> str:
        units, size = self.units, len(self.units)
        try:
            data = b"".join(map(units.__getitem__, ids))
        except IndexError:
            data = b"".join(units[i] for i in ids if 0 <= i < size)
        if data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


class _Shared:
    """The broadcast pieces; a Python worker has one encoder, that of the last pieces."""

    def __init__(self, spark, pieces: Pieces):
        self.handle = spark.sparkContext.broadcast(pieces)
        self.digest = pieces.digest

    def encoder(self) -> Encoder:
        if self.digest not in _encoders:
            _encoders.clear()
            _encoders[self.digest] = Encoder(self.handle.value)
        return _encoders[self.digest]


IDS = T.ArrayType(T.IntegerType())


def _ids_array(found: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in found]
    flat = np.concatenate([np.empty(0, np.int32), *[x for x in found if x is not None]])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    nulls = np.array([x is None for x in found], bool)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat), mask=pa.array(nulls) if nulls.any() else None
    )


def encode(
    docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "token_ids"
) -> DataFrame:
    """``docs`` with the piece ids of its texts."""
    shared = _Shared(docs.sparkSession, pieces)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encoder = shared.encoder()
        texts = columns[0].to_pylist()
        return [_ids_array([None if t is None else encoder.encode(t) for t in texts])]

    return rows_with(docs, [text_col], [T.StructField(ids_col, IDS)], run, slice_rows=256)


def decode(
    docs: DataFrame, pieces: Pieces, ids_col: str = "token_ids", text_col: str = "decoded"
) -> DataFrame:
    """``docs`` with the text that its piece ids spell."""
    shared = _Shared(docs.sparkSession, pieces)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encoder = shared.encoder()
        texts = [
            None if ids is None else encoder.decode([i for i in ids if i is not None])
            for ids in columns[0].to_pylist()
        ]
        return [pa.array(texts, pa.string())]

    return rows_with(docs, [ids_col], [T.StructField(text_col, T.StringType())], run, slice_rows=256)


def encode_and_check(
    docs: DataFrame, pieces: Pieces, text_col: str = "text", carry=None
) -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the ids, decoded
    in the same pass, spell the text again."""
    shared = _Shared(docs.sparkSession, pieces)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        encoder = shared.encoder()
        texts = columns[0].to_pylist()
        found = [None if t is None else encoder.encode(t) for t in texts]
        same = [None if t is None else encoder.decode(x.tolist()) == t for t, x in zip(texts, found)]
        sizes = [None if x is None else len(x) for x in found]
        return [_ids_array(found), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]

    fields = [
        T.StructField("token_ids", IDS),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    return rows_with(docs, [text_col], fields, run, carry, slice_rows=256)


def op5_sentencepiece(spark, sf_dir, model_file: str = MODEL):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_check(docs, load_pieces(model_file), carry=["doc_id"]).select(
        "doc_id",
        F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        "token_ids",
        "round_trip",
    )
