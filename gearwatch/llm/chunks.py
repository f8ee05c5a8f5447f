"""Texts cut at spaces into chunks, and numbers for the chunks that a task has met.

Tokenizers that never join across a space before a character that is no white space
give the same tokens for a text and for its chunks. Most chunks of a text were met in
earlier ones, so tokens are looked for once a chunk and taken by its number.

Cut is only at a space that follows neither a space nor the piece models' mark for one
and stands before a character that is neither of them nor white space; all other
white space stays inside its chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

MEMO_BYTES = 96 << 20  # of chunks that a task remembers, about; only saves repeated work
_ENTRY = 200  # bytes of a chunk besides its letters
_BLANK = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff▁"  # white space by any engine's notion
_ODD = regex.compile(rf" (?:[{_BLANK}]|\Z)").search
_CUT = regex.compile(rf"(?<=[^ ▁]) (?=[^{_BLANK}])").split
_BLANKS = frozenset(regex.findall(rf"[{_BLANK}]", "".join(map(chr, range(0x10000)))))


def cut(text: str) -> list[str]:
    """The chunks of a text, which is not empty; joined by spaces they are the text again."""
    if text[0] == " " or "▁" in text or _ODD(text):
        return _CUT(text)
    return text.split(" ")


def can_be_joined(chunk: str) -> bool:
    """Whether the chunk is cut out again of chunks like it that are joined by spaces."""
    return chunk[0] not in _BLANKS and chunk[-1] != " " and "▁" not in chunk


class Chunks:
    """Numbers of chunks, from 0 in the order in which they were met; to be emptied when ``full``."""

    def __init__(self, limit: int | None = None):
        self.limit = MEMO_BYTES if limit is None else limit
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0

    @property
    def full(self) -> bool:
        return self.bytes > self.limit

    def add(self, chunks: list[str], first: Callable[[str], bool] | None = None) -> list[str]:
        """Number those not met before, ``first`` ones first; these, in the order of their numbers."""
        fresh, n = list(set(chunks).difference(self.number)), len(self.number)
        if first:
            fresh.sort(key=first, reverse=True)
        self.number.update(zip(fresh, range(n, n + len(fresh))))
        self.bytes += _ENTRY * len(fresh) + sum(map(len, fresh))
        return fresh

    def numbers(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, chunks), dtype=np.int64, count=len(chunks))
