"""Shared text conventions of this subpackage.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. A null text reads as the empty
text. All helpers take whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: ASCII upper case to lower case; every word separator to a space.
FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def folded_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8. Lone surrogates cannot occur in Spark strings."""
    return text.encode("utf-8", "replace").translate(FOLD).split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words give the one whole sequence; none give nothing."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= k:
        return np.array([digest(joined, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - k + 1].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def texts_of(series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in series]


def text_chunks(texts: list[str], chars: int = 4_000_000):
    """Slices of a batch with about `chars` characters each, so that vector work has a bounded size."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def byte_chunks(texts: pa.Array, most: int = 2_000_000):
    """Slices of an Arrow column with about `most` bytes each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi
