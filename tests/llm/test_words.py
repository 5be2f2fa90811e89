import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import words as W

TEXT = st.lists(st.text(alphabet="aAbB \t\nÉé.,\x0b ", max_size=40), max_size=6)


def plain(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text))


@settings(max_examples=60, deadline=None)
@given(TEXT, st.sampled_from([1 << 20, 7]))
def test_words_and_shingles(texts, step):
    raw = [t.encode() for t in texts]
    old, W.STEP = W.STEP, step
    try:
        h, bounds = W.hashed(raw)
    finally:
        W.STEP = old
    names: dict[bytes, int] = {}
    for i, t in enumerate(raw):
        own = plain(t)
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    s, at = W.shingles(h, bounds)
    sets: dict[tuple, int] = {}
    for i, t in enumerate(raw):
        own = plain(t)
        want = {tuple(own[j : j + 5]) for j in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()}
        got = s[at[i] : at[i + 1]]
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        if len(want) == 1:
            (w,) = want
            assert sets.setdefault(w, int(got[0])) == int(got[0])


def test_a_long_text_is_cut_at_white_space():
    word = b"x" * (W.STEP + 10)
    h, bounds = W.hashed([b"a " * W.STEP, word, word + b" b"])
    assert np.diff(bounds).tolist() == [W.STEP, 1, 2]
    assert len(set(h[: W.STEP].tolist())) == 1 and h[bounds[1]] == h[bounds[2]]
