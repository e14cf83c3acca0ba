"""Texts as words for the language model: a 64-bit name for each, and its spelling in symbols.

A word is a run of characters other than white space. A word equal to the one before it in the text becomes the word
REPEATED; each text (or part of one that is read in parts) is closed by the word END.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Names of the two words that aren't runs of characters, and what comes before a text's first word.
END, REPEATED, START = np.uint64(1), np.uint64(2), np.uint64(3)
_B = np.uint64(0x9E3779B97F4A7C15)
_shared: dict = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(before: np.ndarray, name: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair of words."""
    return mixed(before * _B + name)


@dataclass(frozen=True)
class Words:
    """All words of some texts in order. ``first`` is where each text starts (one entry more than texts)."""

    name: np.ndarray
    text: np.ndarray
    first: np.ndarray
    symbols: np.ndarray
    begin: np.ndarray  # each word's place in symbols
    end: np.ndarray


def words_of(texts: list[str], alphabet: np.ndarray, space: int, repeat: int, gaps: tuple[int, ...]) -> Words:
    """The words of every text, each spelled as its characters' symbols and a closing space."""
    points = [np.frombuffer(f"{t} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    del points
    known = alphabet[np.minimum(flat, 0xFFFF)]
    gap = np.isin(known, gaps)
    known[gap] = space
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length = end - begin
    longest = int(length.max()) if len(length) else 0
    if "powers" not in _shared or len(_shared["powers"]) < longest:
        _shared["powers"] = np.cumprod(np.full(max(1 << 12, longest), _B))
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    inside = flat[~gap].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(inside * _shared["powers"][place])])
    at = np.cumsum(length)
    name = mixed(sums[at] - sums[at - length] + length.astype(np.uint64))
    if longest > 1 << 16:
        del _shared["powers"]
    text = np.searchsorted(starts, begin, side="right") - 1
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
    # The closing word of text k comes after its words; two symbols are added for the words without characters.
    counts = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    to = np.arange(len(name)) + text
    n = len(name) + len(texts)
    out, b, e = np.full(n, END), np.full(n, len(known)), np.full(n, len(known) + 1)
    out[to] = np.where(same, REPEATED, name)
    b[to] = np.where(same, len(known) + 1, begin)
    e[to] = np.where(same, len(known) + 2, end + 1)
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    return Words(out, owner, first, np.concatenate([known, np.array([space, repeat], np.uint8)]), b, e)


def spelled(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram code of every symbol of every word, three spaces (symbol 0) being a word's first context; and where each word's start."""
    length = end - begin
    start = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(start, length)
    at = np.repeat(begin, length) + inside
    code = symbols[at].astype(np.int64)
    for back in (1, 2, 3):
        code += np.where(inside >= back, symbols[np.maximum(at - back, 0)], 0).astype(np.int64) * size**back
    return code, start
