"""Words and word shingles as 64-bit fingerprints, computed on whole byte buffers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes of a buffer that is hashed at once; a longer text is cut at white space.
STEP = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a splitmix finaliser)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """Byte values, and powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[1]) < n:
        size = max(n, STEP + 1)
        power = np.full(size, U(_BASE))
        power[0] = 1
        inverse = np.full(size, U(pow(_BASE, -1, 1 << 64)))
        inverse[0] = 1
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += U(32)
        _powers[:] = [mixed(folded), np.multiply.accumulate(power), np.multiply.accumulate(inverse)]
    return _powers


def _separators(punctuation: bool) -> np.ndarray:
    """Bytes between words: space and 09-0D; with ``punctuation`` all ASCII that is no letter or digit."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    if punctuation:
        out[:128] = [not chr(c).isalnum() for c in range(128)]
    return out


_SPACE, _PLAIN = _separators(False), _separators(True)


def _hash(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the words of a buffer."""
    values, power, inverse = _tables(len(raw) + 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    v = values[raw]
    v[gap] = 0
    v *= power[: len(raw)]
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(v, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return start, mixed(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def hashed(texts: Sequence[bytes], punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts in turn, and where each text's words start (one entry more than texts).

    A-Z are lower-cased. Equal words have equal fingerprints; two different ones agree with odds of about 2**-64.
    """
    separator = _PLAIN if punctuation else _SPACE
    found, counts = [], np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        if len(texts[i]) > STEP:
            raw = np.frombuffer(texts[i], np.uint8)
            gap = separator[raw]
            at = 0
            while at < len(raw):
                end = min(len(raw), at + STEP)
                if end < len(raw):
                    back = np.flatnonzero(gap[at:end])
                    if len(back):
                        end = at + int(back[-1]) + 1
                    else:
                        on = np.flatnonzero(gap[end:])
                        end = end + int(on[0]) if len(on) else len(raw)
                h = _hash(raw[at:end], gap[at:end])[1]
                found.append(h)
                counts[i] += len(h)
                at = end
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and total + len(texts[j]) + 1 <= STEP:
            total += len(texts[j]) + 1
            j += 1
        j = max(j, i + 1)
        raw = np.frombuffer(b" ".join(texts[i:j]), np.uint8)
        gap = separator[raw]
        start, h = _hash(raw, gap)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts[i:j] = np.diff(np.searchsorted(start, ends, "left"), prepend=0)
        found.append(h)
        i = j
    return (np.concatenate(found) if found else np.zeros(0, U)), np.concatenate(([0], np.cumsum(counts)))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, ascending within a text, with the texts' bounds.

    A text of fewer than k words has its whole sequence as one; a text without words has none.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    if not len(words):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(n), size)
    left = np.repeat(bounds[1:], size) - np.arange(len(words))  # words from here to the end of the text
    h = np.zeros(len(words), U)
    for i in range(k):
        w = np.zeros(len(words), U)
        w[: max(0, len(words) - i)] = words[i:]
        w[left <= i] = U(0x5851F42D4C957F2D)
        h = h * U(_BASE | 1) + w
    keep = (left >= k) | (np.arange(len(words)) == bounds[:-1][doc])
    keep &= (left >= k) | (size[doc] < k)
    h, doc = mixed(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(n + 1))
