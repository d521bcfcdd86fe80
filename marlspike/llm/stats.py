"""Counts over one whole text that the quality operators share."""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np

SPACE, UPPER, LOWER, DIGIT, SYMBOL, BANG, PUNCT, OTHER = range(8)
#: Characters that count as symbols, and the word separators.
SYMBOLS, SEPARATORS = "#*$%&|<>", " \t\n\x0b\x0c\r"


class Stats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    upper: int
    letters: int
    digits: int
    bangs: int
    punct: int
    distinct: int
    adjacent: int
    commonest: int


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point of the basic plane; the rest reads as U+FFFF."""
    kinds = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Nd": DIGIT}
    table = np.full(65536, OTHER, np.uint8)
    for i in range(65536):
        c = unicodedata.category(chr(i))
        table[i] = kinds.get(c, PUNCT if c[0] == "P" else OTHER)
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    for c in SEPARATORS:
        table[ord(c)] = SPACE
    table[ord("!")] = BANG
    return table


def repeat_words(ids: np.ndarray, vocabulary: int, k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more, the first occurrence included."""
    n = len(ids) - k + 1
    if n < 2:
        return 0
    code, size = ids[:n].astype(np.int64), vocabulary
    for i in range(1, k):
        if size * vocabulary >= 2**62:  # renumber the windows so far, so that the code stays exact
            kinds, code = np.unique(code, return_inverse=True)
            size = len(kinds)
        code = code * vocabulary + ids[i : i + n]
        size *= vocabulary
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def of(text: str) -> Stats:
    """The counts of one text; a text without words has zeros."""
    counts = np.zeros(8, np.int64)
    table = classes()
    for lo in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[lo : lo + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")
        counts += np.bincount(table[np.minimum(points, 65535)], minlength=8)
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return Stats(*[0] * 14)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SEPARATORS)] if len(lines) > 1 else lines
    return Stats(
        len(words), len(text) - int(counts[SPACE]), int(counts[SYMBOL]), len(full) - len(set(full)), repeat_words(ids, len(seen)), len(full),
        int(counts[UPPER]), int(counts[UPPER] + counts[LOWER]), int(counts[DIGIT]), int(counts[BANG]), int(counts[PUNCT]), len(seen),
        int((ids[1:] == ids[:-1]).sum()), int(np.bincount(ids).max()),
    )
