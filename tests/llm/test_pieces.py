import random

import public_tokenizers as P
import pytest
import regex

from vectide.llm import pieces

PARTS = ["word", " ", "  ", "\n", "\t", " ", " ", "\x1c", "'s", "don't", "é", "日本", "🙂", "12", "!", " a", "b ", "<|x|>", "́"]


def texts(n=300):
    r = random.Random(9)
    return ["".join(r.choice(PARTS) for _ in range(r.choice((0, 1, 2, 5, 30, 200)))) for _ in range(n)] + ["a b " * 900, " " * 300, "x" * 3000]


def test_cut_keeps_the_tokens():
    own = regex.compile(pieces.PATTERN)
    assert pieces.PATTERN == P.PATTERN
    for t in texts():
        parts = pieces.cut(t)
        parts = parts[:1] + [" " + p for p in parts[1:]]
        assert "".join(parts) == t
        assert [x for p in parts for x in own.findall(p)] == own.findall(t)


@pytest.mark.parametrize("limit", [4, 1 << 18])
def test_pieces_are_those_of_the_text(monkeypatch, limit):
    monkeypatch.setattr(pieces, "PIECES", limit)
    own = regex.compile(pieces.PATTERN)
    made = pieces.Pieces(lambda x: [len(own.findall(p)) for p in x])
    all_ = texts()
    for i in range(0, len(all_), 7):
        assert [sum(x) for x in made(all_[i : i + 7])] == [len(own.findall(t)) for t in all_[i : i + 7]]
