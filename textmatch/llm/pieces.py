"""A piece vocabulary with log scores, and how texts fall into independent pre-tokens."""

from __future__ import annotations

import hashlib
import math
import re
import string
from dataclasses import dataclass
from functools import cached_property

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a blank inside pieces
UNKNOWN_PENALTY = 10.0  # below the least score, for a character that no piece covers


@dataclass(frozen=True)
class Pieces:
    """``scores`` maps the text of an ordinary piece to (id, log score)."""

    scores: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    size: int

    @cached_property
    def digest(self) -> str:
        """The same for the same pieces, ids and scores, in every process."""
        return hashlib.md5(repr((sorted(self.scores.items()), self.byte_ids)).encode()).hexdigest()

    @cached_property
    def unknown_score(self) -> float:
        return min(s for _, s in self.scores.values()) - UNKNOWN_PENALTY

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores))

    @cached_property
    def _splitter(self) -> re.Pattern | None:
        """Cuts before blanks, around line ends and before marks, where the pieces allow each.

        No piece may cross a cut, or the cut would change the best path. The marks are those of
        ASCII and, as long as there are any, the characters that a piece has before a mark.
        """
        inner = [p for p in self.scores if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in inner):
            return None
        line = "" if any("\n" in p for p in inner) else "\n"
        marks, before = set(), set(string.punctuation)
        while before:
            marks |= before
            before = {a for p in inner for a, b in zip(p, p[1:]) if b in marks} - marks - {MARK}
        if any(c.isalpha() or c.isspace() for c in marks):
            return re.compile(f" *[^ {line}]+|\n| +")
        mark = "".join(map(re.escape, sorted(marks)))
        return re.compile(f" *[{mark}]*[^ {line}{mark}]+| *[{mark}]+|\n| +")

    def pre_tokens(self, text: str) -> list[str]:
        """The text after one leading blank, cut where no piece can cross; '' gives none."""
        if not text:
            return []
        return self._splitter.findall(" " + text) if self._splitter else [" " + text]


def load_pieces(model_file: str = MODEL) -> Pieces:
    """Read a SentencePiece model.

    The scores of a model of merges are whole numbers that order its pieces, not logarithms.
    There a piece's rank ``r``, its place among the ordinary pieces, is read as the log
    probability of Zipf's law, ``-log(r + 1) - log(H)``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    skip = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
    plain = [i for i in range(size) if not skip[i] and not model.is_byte(i)]
    raw = [model.get_score(i) for i in plain]
    if all(s == round(s) for s in raw):
        total = math.log(sum(1 / (r + 1) for r in range(len(raw))))
        raw = [-math.log(r + 1) - total for r in range(len(raw))]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback: some texts could not be encoded")
    scores = {model.id_to_piece(i): (i, s) for i, s in zip(plain, raw)}
    return Pieces(scores, tuple(byte_ids[b] for b in range(256)), size)
