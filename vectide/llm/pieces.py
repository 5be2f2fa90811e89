"""Texts in pieces that a byte-level tokenizer encodes independently, each different piece encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

#: Fixed value: the pre-tokenizer pattern of byte-level BPE for which cut() is proven (that of ByteLevel in tokenizers).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that are remembered, and characters of one at most.
PIECES, PIECE_CHARS = 1 << 18, 48
_CUT = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str) -> list[str]:
    """The text in pieces, each but the first without the space that it begins with.

    A cut lies between a character that is no white space and a single space before another such character. No token
    of PATTERN goes on over such a place (a space only begins one there) and none looks behind itself or further ahead
    than to white space, so the pieces' tokens, one piece after the other, are those of the text.
    """
    return [p[1:] if i else p for i, p in enumerate(_CUT.split(text))]


def odd(piece: str) -> bool:
    """Whether a split at each space is no cut() at this piece's ends."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


class Pieces:
    """What ``encode`` makes of pieces: a value for each string of a list. At most PIECES values are remembered."""

    def __init__(self, encode: Callable[[list[str]], list]) -> None:
        self.encode = encode
        self.known: dict[str, object] = {}

    def _learn(self, parts: list[list[str]]) -> None:
        if len(self.known) > PIECES:
            self.known.clear()
        new = [p for p in set(chain.from_iterable(x[1:] for x in parts)).difference(self.known) if len(p) <= PIECE_CHARS and not odd(p)]
        self.known.update(zip(new, self.encode([" " + p for p in new]), strict=True))

    def __call__(self, texts: Sequence[str]) -> list[list]:
        """The values of each text's pieces, in order."""
        parts = [t.split(" ") for t in texts]
        self._learn(parts)
        out = []
        for text, first, own in zip(texts, self.encode([p[0] for p in parts]), parts, strict=True):
            found = list(map(self.known.get, own))
            found[0] = first
            if None in found or odd(own[0][-1:]):
                own = cut(text)
                found = [None if i == 0 or odd(p) else self.known.get(p) for i, p in enumerate(own)]
                todo = [i for i, v in enumerate(found) if v is None]
                for i, v in zip(todo, self.encode([" " + own[i] if i else own[i] for i in todo]), strict=True):
                    found[i] = v
            out.append(found)
        return out
