"""Hashed words and shingles of texts, by array operations."""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_PLANE, _WORD = 1 << 16, 1 << 12
#: Characters that are read at once; some 60 bytes each are held meanwhile.
CHUNK = 1 << 18
_SPACE = re.compile(r"\s")
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the basic plane, each character in lower case and whether it is white space; weights of a word's places."""
    if not _tables:
        lower, space = np.arange(_PLANE, dtype=np.uint32), np.zeros(_PLANE, bool)
        for c in range(_PLANE):
            small = chr(c).lower()
            if len(small) == 1 and ord(small) < _PLANE:
                lower[c] = ord(small)
            space[c] = chr(c).isspace()
        _tables["lower"], _tables["space"] = lower, space
        _tables["weight"] = np.cumprod(np.full(_WORD, _U(0x9E3779B97F4A7C15)))
    return _tables["lower"], _tables["space"], _tables["weight"]


def _chunk(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower, space, weight = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    basic = np.minimum(points, _PLANE - 1)
    gap = space[basic] & (points < _PLANE)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, _U), begin, end
    small = np.where(points < _PLANE, lower[basic], points).astype(_U)
    since = np.concatenate([[0], begin])
    inside = np.arange(len(points)) - np.repeat(since, np.diff(np.concatenate([since, [len(points)]])))
    place = weight[inside & (_WORD - 1)]
    if len(points) > _WORD and int((end - begin).max()) > _WORD:
        place = place * ((inside >> 12).astype(_U) * _U(2) + _U(1))
    sums = np.concatenate([[_U(0)], np.cumsum(np.where(gap, _U(0), (small + _U(1)) * place))])
    return mix(sums[end] - sums[begin]), begin, end


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every word of a text in lower case, places in characters.

    A long text is read in chunks that end at white space, so memory follows the words, not ten times the characters.
    """
    if len(text) <= CHUNK:
        return _chunk(text)
    parts, at = [], 0
    while at < len(text):
        to = at + CHUNK
        found = _SPACE.search(text, to) if to < len(text) else None
        to = found.start() if found else len(text)
        h, begin, end = _chunk(text[at:to])
        parts.append((h, begin + at, end + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words; fewer words are one shingle, no words none."""
    if not len(words):
        return np.zeros(0, _U)
    n = min(size, len(words))
    m = len(words) - n + 1
    out = np.full(m, n, _U)
    for i in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[i : i + m])
    return out
