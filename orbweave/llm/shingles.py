"""Hashes of all words and word shingles of many texts at once, with numpy over their bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Lower-case bytes of words (ASCII letters and digits, and all of non-ASCII); 0 between words.
ALNUM = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], dtype=np.uint8)
#: The same for words between ASCII white space, case kept.
SPACE = np.array([0 if c == 0 or c == 32 or 9 <= c <= 13 else c for c in range(256)], dtype=np.uint8)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, the index of its text) over all texts in order; equal words have equal hashes."""
    raw = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
    folded = fold[raw]
    edge = np.diff((folded != 0).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    power, inverse = _grow(len(raw) + 1)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * power[: len(raw)], dtype=np.uint64)))
    hashes = mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(firsts, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of words i to i + k - 1, whether they are all of one text) for each i that has k - 1 words after it."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h), text[:n] == text[k - 1 : k - 1 + n]
