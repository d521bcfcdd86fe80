"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and white space is collapsed. An item of n bytes that occurs in a document with at most k edits
(k = `errors` x n) shares at least n + 1 - q (k + 1) byte q-grams with it, and their positions lie on diagonals no
further than k apart. Shared q-grams are counted in overlapping bands of 2k + 1 diagonals, stepping k + 1; bands that
meet the bound are kept, and each is verified by banded alignment of the whole item against the region. The edit budget
of short items shrinks so that the bound stays positive.

Items under `SHORT` bytes once collapsed have no budget of edits: they are found where they stand word for word, with no
letter or digit next to them, all at once by an automaton over the block's short items.

The items are read in blocks of a bounded size, and each block is matched against all documents in one narrow pass;
nothing is shuffled. A worker keeps the indexes of the blocks it has met last. A benchmark of many blocks costs a pass
for each.

Defined cases: null and empty items, and those of white space, are not searched for; null and empty texts have no
match; repeated rows match alike; a null identifier of a document is carried along, that of an item is -1; an empty
table on either side gives no match; other columns do not matter, and `clean` keeps them.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.llm.text import text_chunks, texts_of
from marlspike.session import ship

Q, TABLE_BITS, SHORT = 12, 20, 40
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MATCH = "item_id long, start long, end long, n_edits int, item_length int"


def collapse(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(buffer: bytes) -> np.ndarray:
    """A 64-bit code for each q-gram of the buffer, from its first and its last 8 bytes."""
    n = len(buffer) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = buffer + b"\0" * 16
    windows = np.empty(len(buffer), np.uint64)
    for i in range(8):
        part = np.frombuffer(padded, "<u8", (len(buffer) - i + 7) // 8, i)
        windows[i::8] = part[: len(windows[i::8])]
    return windows[:n] * MIX[0] ^ windows[Q - 8 : Q - 8 + n] * MIX[1]


def banded_distance(item: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole item in the region, or None if it takes over `budget` edits.

    Semi-global alignment: gaps before and after the item's place cost nothing. The region is no longer than the item
    and twice the band, so the table stays banded by construction.
    """
    if (at := region.find(item)) >= 0:
        return 0, at, at + len(item)
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    row, begin = np.zeros(len(b) + 1, np.int32), np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1, dtype=np.int32)
    for i, c in enumerate(a, 1):
        diagonal, above = row[:-1] + (b != c), row[1:] + 1
        fresh = np.r_[np.int32(i), np.minimum(diagonal, above)]
        came = np.r_[0, np.where(diagonal <= above, begin[:-1], begin[1:])]
        low = np.minimum.accumulate(fresh - steps)  # gaps along the region
        source = np.maximum.accumulate(np.where(fresh - steps == low, steps, 0))
        row, begin = (low + steps).astype(np.int32), came[source]
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(begin[end]), end) if row[end] <= budget else None


class Block:
    """q-grams of a block of items, with the positions of each."""

    def __init__(self, items: list[tuple[int, bytes]], errors: float):
        self.short = ahocorasick.Automaton()
        for i, t in items:
            if len(t) < SHORT:
                word = t.decode("utf-8")
                self.short.get(word, None) or self.short.add_word(word, (len(word), len(t), []))
                self.short.get(word)[2].append(i)
        if len(self.short):
            self.short.make_automaton()
        items = [x for x in items if len(x[1]) >= SHORT]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        length = np.array([len(t) for t in self.texts], np.int64)
        self.shift = int(length.max(initial=0)) + 1  # keeps diagonals above zero
        # the most edits that leave the bound at 2 or more shared q-grams
        self.budget = np.minimum((errors * length).astype(np.int64), (length - 1) // Q - 1).clip(0)
        self.need = (length + 1 - Q * (self.budget + 1)).clip(1)
        codes = [grams(t) for t in self.texts]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes]) if codes else item
        order = np.argsort(code, kind="stable")
        self.item, self.at = item[order], at[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.r_[first, len(code)].astype(np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.codes)] = True

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * MIX[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item id, start, end, edits, item length), the best place of each item in a band."""
        packed = [collapse(t) for t in texts]
        return sorted(self.long_matches(packed) + self.short_matches(packed)) if len(self.short) else self.long_matches(packed)

    def short_matches(self, packed: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        found = []
        for d, raw in enumerate(packed):
            text = raw.decode("utf-8")
            for last, (n, size, ids) in self.short.iter(text):
                at = last + 1 - n
                if (at and text[at - 1].isalnum() and text[at].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum() and text[last].isalnum()):
                    continue
                start = len(text[:at].encode("utf-8"))
                found += [(d, i, start, start + size, 0, size) for i in ids]
        return found

    def long_matches(self, packed: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        gap = b"\0" * (Q + 4)  # no item holds it, so no q-gram crosses two texts
        buffer = gap.join(packed)
        code = grams(buffer)
        if not len(code) or not len(self.codes):
            return []
        at = np.flatnonzero(self.table[self.slot(code)])
        place = np.searchsorted(self.codes, code[at])
        true = self.codes[np.minimum(place, len(self.codes) - 1)] == code[at]
        at, place = at[true], place[true]
        reps = self.first[place + 1] - self.first[place]
        pick = np.repeat(self.first[place], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        item, diagonal = self.item[pick], np.repeat(at, reps) - self.at[pick]
        step = self.budget[item] + 1
        band = (diagonal + self.shift) // step  # of width step; an overlapping band is this one and the next
        key = item * (1 << 40) + band
        order = np.argsort(key, kind="stable")
        kinds, counts = np.unique(key[order], return_counts=True)
        follows = np.r_[kinds[1:] == kinds[:-1] + 1, False]
        total = counts + np.where(follows, np.r_[counts[1:], 0], 0)
        keep = total >= self.need[kinds >> 40]
        starts = np.cumsum([0] + [len(p) + len(gap) for p in packed])
        found = {}
        for k in kinds[keep]:
            j, low = int(k >> 40), int(k & (1 << 40) - 1)
            slack = int(self.budget[j])
            lo = low * (slack + 1) - self.shift - slack
            hi = lo + len(self.texts[j]) + 2 * (slack + 1) + 2 * slack
            near = (max(0, lo) + hi) // 2
            doc = int(np.searchsorted(starts, min(max(near, 0), len(buffer)), side="right")) - 1
            left, right = int(starts[doc]), int(starts[doc]) + len(packed[doc])
            base = max(lo, left)
            hit = banded_distance(self.texts[j], buffer[base : min(hi, right)], slack)
            if hit:
                place_ = (doc, j, base - left + hit[1])
                found[place_] = min(found.get(place_, (slack + 1, 0)), (hit[0], base - left + hit[2]))
        return [(d, self.ids[j], s, e, n, len(self.texts[j])) for (d, j, s), (n, e) in sorted(found.items())]


#: Indexes of blocks that this process has made, newest last.
_BLOCKS: dict[str, Block] = {}


def block_of(name: str, items: list[tuple[int, bytes]], errors: float, most: int = 4) -> Block:
    """The block of that name, made once in a process; the oldest go beyond `most`."""
    if name not in _BLOCKS:
        while len(_BLOCKS) >= most:
            _BLOCKS.pop(next(iter(_BLOCKS)))
        _BLOCKS[name] = Block(items, errors)
    return _BLOCKS[name]


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str):
    """Blocks of (id, collapsed text) of a bounded size; items stream to the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        if t := collapse(r[1]):
            block.append((r[0] if r[0] is not None else -1, t))
            size += len(t)
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = 0.05, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, n_edits, item_length) for each place of an item in a document.

    Places are bytes of the collapsed text. At most `errors` x length edits count as an occurrence.
    """
    ship(docs.sparkSession)
    out = None
    for items in item_blocks(benchmark, block_bytes, "item_id", "text"):

        def search(batches, items=items, name=uuid.uuid4().hex):
            block = block_of(name, items, errors)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), texts_of(pd.Series(b.column(1).to_pylist(), dtype=object))
                for lo, hi in text_chunks(texts, 2_000_000):
                    rows = block.matches(texts[lo:hi])
                    cols = list(zip(*rows)) or [[]] * 6
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    first = [ids[lo + i] for i in cols[0]]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip([first, *cols[1:]], kinds)], ["doc_id", "item_id", "start", "end", "n_edits", "item_length"])

        part = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(search, f"doc_id long, {MATCH}")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id long, {MATCH}")


def holds_any(items: list[tuple[int, bytes]], errors: float):
    """A Boolean function of a text: whether it holds one of the items."""
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        block, all_texts, out = block_of(name, items, errors), texts_of(texts), []
        for lo, hi in text_chunks(all_texts, 2_000_000):
            bad = {m[0] for m in block.matches(all_texts[lo:hi])}
            out += [i in bad for i in range(hi - lo)]
        return pd.Series(out, dtype=bool)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = 0.05, block_bytes: int = 4 << 20, text_col: str = "text") -> DataFrame:
    """`docs` without the documents that hold a benchmark item; all columns stay as they are."""
    ship(docs.sparkSession)
    for items in item_blocks(benchmark, block_bytes, "item_id", "text"):
        docs = docs.where(~holds_any(items, errors)(F.col(text_col)))
    return docs
