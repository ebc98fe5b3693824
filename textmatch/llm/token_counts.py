"""Token counts by one dynamic programme over a trie of pre-tokens.

The distinct pre-tokens of a task's documents are inserted in a trie. A node is a prefix; it
keeps the best unigram score of spelling that prefix with pieces and the number of tokens of
that spelling, worked out once from the nodes above it, however many pre-tokens go on from
there. The node where a pre-token ends thus holds its token count, and a document's count is
the sum over its pre-tokens. The trie is kept from batch to batch and begun anew at ``NODES``
nodes, which bounds the memory and changes no count. Rows don't move.

The counts equal the lengths of the lists that ``sentencepiece.encode`` gives, ties included.

Defined results: a null or empty text has no tokens. Repeated rows are counted each; an empty
table gives no rows. Other columns pass unchanged; those named as a result are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import rows_with, table
from textmatch.llm.pieces import MARK, MODEL, Pieces, load_pieces

NODES = 500_000


_SPAN = 0x110000  # more than any code point


class CountingTrie:
    """Prefix nodes with forward scores and token counts, in flat tables.

    Node numbers count up; ``children`` maps ``node * _SPAN + code point`` to a node.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.single = {ord(p) for p in pieces.scores if len(p) == 1}
        #: the pieces spelled backwards, as nested tables; a score lies under None
        self.endings: dict = {}
        for piece, (_, score) in pieces.scores.items():
            below = self.endings
            for character in reversed(piece):
                below = below.setdefault(ord(character), {})
            below[None] = score
        self._begin()

    def _begin(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.counted: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        known = self.counted.get(pre_token)
        if known is not None:
            return known
        if len(self.best) >= NODES or len(self.counted) >= NODES:
            self._begin()
        # A blank is spelled as a mark. A mark of the text itself becomes a code point that no
        # text has, so that no piece covers it; it takes as many bytes.
        spelled = pre_token.replace(MARK, "\ud800").replace(" ", MARK)
        tokens = self._insert(list(map(ord, spelled)))
        if len(pre_token) <= 64:
            self.counted[pre_token] = tokens
        return tokens

    def _insert(self, codes: list[int]) -> int:
        children, path, node = self.children, [0], 0
        for last, code in enumerate(codes):
            key = node * _SPAN + code
            node = children.get(key)
            if node is None:
                node = children[key] = self._node(codes, last, path)
            path.append(node)
        return self.tokens[node]

    def _node(self, codes: list[int], last: int, path: list[int]) -> int:
        """Add the prefix that ends with character ``last``, below the last node of ``path``."""
        best, tokens = self.best, self.tokens
        top = count = None
        piece = self.endings
        # Pieces that end here, from the shortest to the longest; of equals the longest counts,
        # as a search from left to right would find it first.
        for start in range(last, -1, -1):
            piece = piece.get(codes[start])
            if piece is None:
                break
            score = piece.get(None)
            if score is not None:
                before = path[start]
                score = best[before] + score
                if top is None or score >= top:
                    top, count = score, tokens[before] + 1
        code = codes[last]
        if code not in self.single:
            before = path[last]
            score = best[before] + self.pieces.unknown_score
            if top is None or score > top:
                width = 1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4
                top, count = score, tokens[before] + width
        best.append(top)
        tokens.append(count)
        return len(best) - 1


_tries: dict[str, CountingTrie] = {}


def token_counts(docs: DataFrame, pieces: Pieces, text_col: str = "text", carry=None) -> DataFrame:
    """``docs`` with ``n_pre_tokens`` and ``n_tokens``."""
    handle = docs.sparkSession.sparkContext.broadcast(pieces)
    name = pieces.digest

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        if name not in _tries:
            _tries.clear()
            _tries[name] = CountingTrie(handle.value)
        trie = _tries[name]
        split = [trie.pieces.pre_tokens(t) if t else [] for t in columns[0].to_pylist()]
        # Sorted, so that the trie grows along shared prefixes.
        fresh = {w for words in split for w in words}
        counts = {w: trie.count(w) for w in sorted(fresh)}
        return [
            pa.array([len(words) for words in split], pa.int64()),
            pa.array([sum(map(counts.__getitem__, words)) for words in split], pa.int64()),
        ]

    fields = [
        T.StructField("n_pre_tokens", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
    return rows_with(docs, [text_col], fields, run, carry, slice_rows=256)


def totals(counted: DataFrame, *keys: str) -> DataFrame:
    """Documents and tokens per group, for a token budget."""
    return counted.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens")
    )


def op4_token_counts(spark, sf_dir, model_file: str = MODEL):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, load_pieces(model_file), carry=["doc_id"])
