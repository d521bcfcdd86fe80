"""Near-duplicate texts by shingle similarity: segment-popcount embedding of the whole shingle bitmap.

A text's fingerprint here is the bitmap over all 64-bit hash values with one bit for each distinct shingle, kept as a
sorted list. It is embedded as 128 bit counts, one per segment of the hash range (a count over 14 is kept as 15, which
can only lessen distances). The Manhattan distance of two embeddings never exceeds the bitmaps' Hamming distance, and
two sets of a and b shingles are alike by t or more just if that is at most (a + b) * (1 - t) / (1 + t). So the
embedding is an exact filter: it drops no pair that is alike enough.

A grid deals out the pairs to be filtered. Alike sets share at least t times the size of either, so in any one order
of all shingles the first they share is among the first size - ceil(t * size) + 1 of each: these are a text's cells.
The order is rarest first by a fixed number of counters, so shingles of many texts seldom become cells; any order is
exact. Cells with the same members are one cell. Cells over `BLOCK` members are split into blocks that meet two by
two, so no task holds a cell of any size.

First rows are linked by their 64-bit SimHash fingerprints (`simhash.print_links`), and these links are verified by the
whole sets. A fingerprint within 3 bits reaches the nearest only, so the rest goes over the cells.

Inside a cell leaders are linked with the rows in range of them. Each such pair is compared again by embeddings of as
many segments as the sets have shingles or more (again an exact filter, and a tenth of the texts' size), and what
passes is verified by its whole sets. Then, until nothing is left, rows whose groups still differ propose their nearest
rows of other groups. Every pair in range that ends up in two groups has been verified and found less alike, so no link
is lost.

Defined cases: a null text is the empty text; texts without words are alike; texts of fewer than k words have their
whole sequence as the one shingle; repeated rows are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.llm import simhash
from marlspike.llm.components import components, edges_of, small_pairs, whole_cells
from marlspike.llm.text import folded_words, shingle_hashes
from marlspike.session import CLEANUP, RECORDS, discard, materialize, settings

#: Counters that shingles share for the order of prefixes; it settles how many pairs meet, never which are found.
COUNTERS = 1 << 18
SEGMENTS, FULL = 128, 15
#: Members of a cell that one task holds.
BLOCK = 16_384
#: Cells of a node that tell where two nodes have met before.
KNOWN = 64
VECTOR = [f"v{i}" for i in range(SEGMENTS // 16)]
#: Pairs of identifiers that may be broadcast: 16 MB of them.
FEW_PAIRS = 1_000_000
#: Texts, or pairs of them, in a batch that goes to Python.
TEXTS = 512
#: In place of a pair, says that some row had more candidates than were given.
MORE = -1


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(folded_words(text or ""), k))


def embedding(found: np.ndarray) -> np.ndarray:
    """Bit counts of the 128 segments, four bits each, in eight 64-bit words."""
    counts = np.minimum(np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=SEGMENTS), FULL).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).view("<u8")


def fine_embedding(found: np.ndarray) -> bytes:
    """Bit counts of so many segments, a power of two, as the set has shingles or more, four bits each."""
    bits = max(6, int(len(found) - 1).bit_length() if len(found) else 0)
    counts = np.minimum(np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def fine_distance(x: bytes, y: bytes) -> int:
    """Manhattan distance of two fine embeddings, the longer one folded to the segments of the shorter one."""
    a, b = (np.stack([v & 15, v >> 4], 1).reshape(-1) for v in (np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)))
    n = min(len(a), len(b))
    a, b = (v.reshape(n, -1).sum(1, dtype=np.int64) for v in (a, b))
    return int(np.abs(a - b).sum())


def unpacked(words: list[np.ndarray]) -> np.ndarray:
    """The embeddings as (rows, 128) bytes; segments come in another order, the same for all."""
    pairs = np.stack(words, 1).view(np.uint8)
    return np.concatenate([pairs & 15, pairs >> 4], axis=1)


def counted(docs: DataFrame, k: int) -> np.ndarray:
    """How many texts hold a shingle of each counter: one array of fixed size, whatever the table."""

    def counts(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                held = np.concatenate([shingle_set(t.as_py(), k) for t in b.column(0).slice(lo, 1024)])
                total += np.bincount((held & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    with settings(docs.sparkSession, {CLEANUP: "true", RECORDS: str(TEXTS)}):
        rows = docs.select("text").mapInArrow(counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix_length(size: int, least: float) -> int:
    """So many shingles of a set, in one order of all, that it shares one of them with each set alike by `least`."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def prints_of(docs: DataFrame, k: int, least: float, counts: np.ndarray) -> DataFrame:
    """(row, d0, d1, size, fp, v0..v7, fine, cells): the set's digest, size, fingerprint, embeddings and rarest shingles.

    The fingerprint is that of all distinct shingles, so equal sets have one.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts)

    def rows(batches):
        count = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                digest, size, mark, vector, fine, cells = [], [], [], [], [], []
                part = b.slice(lo, 1024)
                for text in part.column(1):
                    x = shingle_set(text.as_py(), k)
                    order = np.lexsort((x, count[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    size.append(len(x))
                    mark.append(simhash.fingerprint_of(x))
                    vector.append(embedding(x))
                    fine.append(fine_embedding(x))
                    cells.append(x[order[: prefix_length(len(x), least)]].view(np.int64))
                ends = np.cumsum([0, *map(len, cells)])
                columns = [*np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2).T, np.array(size, np.int64), np.array(mark, np.uint64).view(np.int64), *np.array(vector).view(np.int64).T]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells)))
                yield pa.record_batch([part.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(fine, pa.binary()), lists], ["row", "d0", "d1", "size", "fp", *VECTOR, "fine", "cells"])
        pa.default_memory_pool().release_unused()

    return docs.select("row", "text").mapInArrow(rows, f"row long, d0 long, d1 long, size long, fp long, {', '.join(f'{v} long' for v in VECTOR)}, fine binary, cells array<long>")


def shared_cells(sets: DataFrame) -> DataFrame:
    """(cell, node, size, v0..v7): members of each cell that two or more sets share; a written table.

    Cells with the same members (equal count and 128 bits of XOR over them) are taken once.
    """
    cells = sets.select(F.explode("cells").alias("cell"), "node")
    shared = cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1").select("cell")
    rows = materialize(cells.join(shared, "cell"), "shared")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    alike = rows.groupBy("cell").agg(F.count("*").alias("members"), *marks)
    once = alike.groupBy("members", "x0", "x1").agg(F.min("cell").alias("cell")).select("cell", "members")
    met = rows.join(once, "cell").join(sets.select("node", "size", *VECTOR), "node")
    blocks, own = F.ceil(F.col("members") * 2 / BLOCK).cast("int"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("cell", F.least(x.cast("long"), "own"), F.greatest(x.cast("long"), "own")))
    split = met.withColumn("blocks", blocks).withColumn("own", own)
    dealt = split.withColumn("cell", F.explode(F.when(F.col("members") <= BLOCK, F.array("cell")).otherwise(meet)))
    out = materialize(dealt.select("cell", "node", "size", *VECTOR), "cells")
    discard(rows)
    return out


def with_first_cells(cells: DataFrame) -> DataFrame:
    """`cells` with `others`: the lowest `KNOWN` cells of the node, to see where two nodes have met before.

    A node's cells are as many as its shingles at most, so they are gathered per node.
    """
    own = cells.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("cell")), 1, KNOWN).alias("others"))
    return cells.join(own, "node")


def met_before(cell: int, others: pa.ListArray, most: int = 256) -> np.ndarray:
    """For the rows of a cell which lower cells they are in: (rows, cells) of 0 and 1, the `most` commonest cells.

    Two rows with a 1 in common have met in a lower cell. Cells left out here only mean that a pair comes twice.
    """
    row = np.repeat(np.arange(len(others)), np.diff(others.offsets.to_numpy()))
    ids = others.flatten().to_numpy()
    row, ids = row[ids < cell], ids[ids < cell]
    names, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    common = np.argsort(-count, kind="stable")[:most]
    common = common[count[common] > 1]
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    out = np.zeros((len(others), len(common)), np.float32)
    hit = place[at] >= 0
    out[row[hit], place[at][hit]] = 1
    return out


def in_range(size: np.ndarray, vector: np.ndarray, a, b, least: float) -> np.ndarray:
    """Which of the pairs (a, b) can be alike by `least`, by the Manhattan distance of their embeddings."""
    most = (size[a] + size[b]) * ((1 - least) / (1 + least)) + 1e-6
    far = np.abs(vector[a].view(np.int8) - vector[b].view(np.int8)).sum(-1, dtype=np.int32)
    return (far <= most) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-6)


def leader_pairs(cells: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (u, v), u > v. Small cells give every pair in range, larger ones the rows in range of a leader.

    Rows of a large cell are gone through by size; the first one left leads those left that are in range of it. So a
    cell gives fewer pairs than it has members.
    """

    def groups(cols):
        cell, node, size, vector = cols[0], cols[1], cols[2], unpacked([c.view(np.uint64) for c in cols[3:]])
        first, sizes = edges_of(cell)
        out_u, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in small_pairs(first, sizes):
            hit = in_range(size, vector, a, b, least)
            out_u.append(node[a[hit]])
            out_v.append(node[b[hit]])
        for f, s in zip(first[sizes > 12], sizes[sizes > 12]):
            left = f + np.argsort(size[f : f + s], kind="stable")
            while len(left):
                one, left = left[0], left[1:]
                hit = np.zeros(len(left), bool)
                upto = np.searchsorted(size[left], size[one] / least + 1e-6, side="right")
                hit[:upto] = in_range(size, vector, np.full(upto, one), left[:upto], least)
                out_u.append(node[left[hit]])
                out_v.append(np.full(int(hit.sum()), node[one]))
                left = left[~hit]
        u, v = np.concatenate(out_u), np.concatenate(out_v)
        return np.maximum(u, v), np.minimum(u, v)

    return whole_cells(cells.select("cell", "node", "size", *VECTOR), groups)


def cross_pairs(cells: DataFrame, least: float, nearest: int) -> DataFrame:
    """For rows outside a cell's largest group their `nearest` rows in range whose `label` differs: (u, v), u > v.

    A pair of two groups has a row outside the largest one, so no pair is left out. A row (MORE, MORE) says that some
    row has further ones; the caller then asks again with a larger `nearest`. Rows that have met in a lower cell were
    compared there.
    """

    def groups(cols):
        cell, node, label, size, others = cols[:5]
        vector = unpacked([c.view(np.uint64) for c in cols[5:]])
        out_u, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for f, s in zip(*edges_of(cell)):
            names, own = np.unique(label[f : f + s], return_inverse=True)
            if len(names) == 1:
                continue
            rows = f + np.flatnonzero(own != np.bincount(own).argmax())
            every, step = np.arange(f, f + s)[None], max(1, 4_000_000 // (s * SEGMENTS))
            before = met_before(cell[f], others.slice(f, s))
            for lo in range(0, len(rows), step):
                a = rows[lo : lo + step, None]
                far = np.abs(vector[a].view(np.int8) - vector[every].view(np.int8)).sum(-1, dtype=np.int32)
                ok = (label[a] != label[every]) & (far <= (size[a] + size[every]) * ((1 - least) / (1 + least)) + 1e-6)
                ok &= np.minimum(size[a], size[every]) >= least * np.maximum(size[a], size[every]) - 1e-6
                ok &= before[a[:, 0] - f] @ before.T == 0
                if nearest < s and (ok.sum(1) > nearest).any():
                    far[~ok] = np.iinfo(np.int32).max
                    some = np.argpartition(far, nearest, axis=1)[:, :nearest]
                    r, c = np.nonzero(np.take_along_axis(ok, some, 1))
                    out_u += [node[a[r, 0]], np.array([MORE])]
                    out_v += [node[f + some[r, c]], np.array([MORE])]
                else:
                    r, c = np.nonzero(ok)
                    out_u.append(node[a[r, 0]])
                    out_v.append(node[f + c])
        u, v = np.concatenate(out_u), np.concatenate(out_v)
        return np.maximum(u, v), np.minimum(u, v)

    return whole_cells(with_first_cells(cells).select("cell", "node", "label", "size", "others", *VECTOR), groups)


def both_sides(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(u, v, x, y): each pair with `value` of its two rows; `rows` has columns row and value.

    Up to `FEW_PAIRS` pairs of identifiers are broadcast, so only their rows are shuffled; beyond that all rows are.
    """
    asked = F.broadcast(pairs) if pairs.count() <= FEW_PAIRS else pairs
    first, second = (rows.select("row", F.col(value).alias(t)).join(asked, F.col("row") == F.col(c)).drop("row") for c, t in (("u", "x"), ("v", "y")))
    return first.join(second, ["v", "u"]).sortWithinPartitions("v").select("u", "v", "x", "y")


def close(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (u, v) that can be alike by `least` by their fine embeddings. `sets` has node, size and fine."""

    def near(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                both = x["size"] + y["size"]
                keep[i] = fine_distance(x["fine"], y["fine"]) <= both * ((1 - least) / (1 + least)) + 1e-6
            yield pa.record_batch([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep))

    rows = sets.select(F.col("node").alias("row"), F.struct("size", "fine").alias("s"))
    return both_sides(pairs, rows, "s").mapInArrow(near, "u long, v long")


def similar(pairs: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """Those of `pairs` (u, v) whose whole shingle sets are alike by `least` or more. `docs` has columns row and text."""

    def alike(batches):
        last, held = None, np.empty(0, np.uint64)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (v, x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3))):
                if v != last:  # rows come sorted by v, so a leader's set is made once
                    last, held = v, shingle_set(y.as_py(), k)
                x = shingle_set(x.as_py(), k)
                both = len(np.intersect1d(x, held, assume_unique=True))
                keep[i] = both >= least * (len(x) + len(held) - both) - 1e-9
            yield pa.record_batch([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep))
        pa.default_memory_pool().release_unused()

    return both_sides(pairs, docs, "text").mapInArrow(alike, "u long, v long")


def groups_of(docs: DataFrame, k: int = 5, least: float = 0.8, nearest: int = 16) -> DataFrame:
    """(row, group) for every row of `docs` (row long and unique, text); group is the lowest row of its group.

    Equal sets meet first, by a pre-aggregated minimum, so copies cost one row however many they are. `nearest` settles
    the size of each further round's question, not the result.
    """
    prints = materialize(prints_of(docs, k, least, counted(docs, k)), "prints", TEXTS)
    same = materialize(prints.groupBy("d0", "d1").agg(F.min("row").alias("node")), "same")
    sets = materialize(prints.join(same.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "size", "fp", *VECTOR, "fine", "cells"), "sets")
    slim = materialize(prints.select("row", "d0", "d1"), "slim")
    discard(prints)
    held = cells = shared_cells(sets)
    # Only these texts can be alike; the rest need not move in each round.
    texts = materialize(docs.select("row", "text").join(cells.select(F.col("node").alias("row")).distinct(), "row", "left_semi"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = materialize(close(pairs, sets, least), "close", TEXTS)
        out = materialize(similar(left, texts, k, least), "links", TEXTS)
        discard(left)
        return out

    tested = [simhash.print_links(sets.select("node", "fp"))]
    tested.append(materialize(leader_pairs(cells, least).join(tested[0], ["u", "v"], "left_anti"), "pairs"))
    links = [verified(t) for t in tested]
    roots, more, found = None, True, True
    while more or found:
        if found:
            if roots is not None:
                discard(roots)
            roots = components(reduce(DataFrame.union, links))
        # A cell of one group stays one; the others go on to the next round.
        labelled = cells.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        mixed = labelled.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cell")
        open_ = materialize(labelled.join(mixed, "cell", "left_semi").select("cell", "node", "size", *VECTOR, "label"), "open")
        crossing = materialize(cross_pairs(open_, least, nearest), "cross")
        more = not crossing.where(F.col("u") == MORE).isEmpty()
        fresh = crossing.where(F.col("u") != MORE).join(reduce(DataFrame.union, tested), ["u", "v"], "left_anti")
        tested.append(materialize(fresh, "pairs"))
        links.append(verified(tested[-1]))
        found = not links[-1].isEmpty()
        discard(held, crossing)
        held, cells, nearest = open_, open_.drop("label"), nearest * 8
    discard(held, texts, sets, *tested, *links)
    named = same.join(roots, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("group"))
    out = materialize(slim.join(named, ["d0", "d1"]).select("row", "group"), "groups")
    discard(roots, same, slim)
    return out
