"""Links inside cells, and connected components over links, both without emitting all pairs of a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlspike.session import discard, materialize


def sorted_segments(prints: np.ndarray) -> np.ndarray:
    """Each 2-bit segment's bit count, written with that many low bits set.

    The Hamming distance of two such codes is the Manhattan distance of the two vectors of bit counts.
    """
    high, pairs = prints >> np.uint64(1), np.uint64(0x5555555555555555)
    return ((prints & high & pairs) << np.uint64(1)) | ((prints | high) & pairs)


def within(prints: np.ndarray, counts: np.ndarray, a, b, distance: int) -> np.ndarray:
    """Which of the pairs (a, b) are in range: Manhattan distance of the bit counts first, then the exact distance."""
    a, b = np.broadcast_arrays(a, b)
    hit = np.bitwise_count(counts[a] ^ counts[b]) <= distance
    hit[hit] = np.bitwise_count(prints[a[hit]] ^ prints[b[hit]]) <= distance
    return hit


def forest(prints: np.ndarray, distance: int, exact_over: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints: (member, root) rows, root the lowest row reached.

    A search from each unvisited row over the rows not yet reached. Rows are sorted by popcount once; popcounts of
    linked rows differ by no more than the distance, so each step looks at a slice only. Groups over `exact_over` rows
    are first split by their four 16-bit blocks: three bits spoil three blocks at most, so every link stays inside one
    of the parts.
    """
    n = len(prints)
    if n > exact_over and distance <= 3:
        found = []
        for block in range(4):
            key = prints >> np.uint64(16 * block) & np.uint64(0xFFFF)
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if 1 < len(part):
                    part = np.sort(part)
                    a, b = forest(prints[part], distance, exact_over=n + 1)
                    found.append((part[a], part[b]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    prints = prints[order]
    pops, counts, left = np.bitwise_count(prints).astype(np.int64), sorted_segments(prints), np.ones(n, bool)
    lo, hi = np.searchsorted(pops, pops - distance), np.searchsorted(pops, pops + distance, side="right")
    members, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        reached, at = [start], 0
        while at < len(reached):
            x, at = reached[at], at + 1
            some = lo[x] + np.flatnonzero(left[lo[x] : hi[x]])
            some = some[within(prints, counts, x, some, distance)]
            left[some] = False
            reached += some.tolist()
        if len(reached) > 1:
            own = np.sort(order[reached])
            members.append(own[1:])
            roots.append(np.full(len(own) - 1, own[0]))
    return np.concatenate(members), np.concatenate(roots)


def whole_cells(cells: DataFrame, found) -> DataFrame:
    """Rows (u long, v long) that `found(columns)` gives for whole cells, distinct.

    `cells` has columns cell (long), node (long) and any others; longs come as numpy arrays, the rest as Arrow arrays.
    Rows of a cell meet in one task in sorted order and are streamed; only the last cell of a batch is held until it
    ends.
    """

    def said(parts):
        columns = [c.combine_chunks() for c in pa.Table.from_batches(parts).columns]
        u, v = found([c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else c for c in columns])
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def stream(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell can go on in the next batch
            if cut or held and held[-1].column(0)[-1].as_py() != cell[0]:
                yield said([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield said(held)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(stream, "u long, v long").distinct()


def edges_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each run of equal cells."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return first, np.diff(np.r_[first, len(cell)])


def small_pairs(first: np.ndarray, sizes: np.ndarray, most: int = 12):
    """Arrays (a, b) of all pairs of rows within cells of up to `most` rows, one array for each gap."""
    for gap in range(1, most):
        at = np.flatnonzero((sizes > gap) & (sizes <= most))
        if not len(at):
            break
        reps = sizes[at] - gap
        a = np.repeat(first[at], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        yield a, a + gap


def cell_links(cells: DataFrame, distance: int) -> DataFrame:
    """Links among the rows of each cell: (u long, v long) with u > v. `cells` has columns cell, node and print.

    Small cells are compared all at once, larger ones by `forest`. Only rows of a forest or of small cells leave the
    task, so output grows with members, not with pairs.
    """

    def groups(cols):
        cell, node, prints = cols[0], cols[1], cols[2].view(np.uint64)
        counts, (first, sizes) = sorted_segments(prints), edges_of(cell)
        out_u, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in small_pairs(first, sizes):
            hit = within(prints, counts, a, b, distance)
            out_u.append(node[a[hit]])
            out_v.append(node[b[hit]])
        for f, s in zip(first[sizes > 12], sizes[sizes > 12]):
            a, b = forest(prints[f : f + s], distance)
            out_u.append(node[f + a])
            out_v.append(node[f + b])
        u, v = np.concatenate(out_u), np.concatenate(out_v)
        keep = u != v
        return np.maximum(u, v)[keep], np.minimum(u, v)[keep]

    return whole_cells(cells.select("cell", "node", "print"), groups)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link, root the lowest node it reaches; a written table.

    Alternating star contraction: each node hands its lowest neighbour to its higher neighbours, then to its lower
    ones, until nothing changes; rounds grow with the logarithm of the nodes. Each round writes its edges to the shared
    folder and drops the round's before. Minima are pre-aggregated before the shuffle, and a node with very many links
    meets them in a join that adaptive execution can split.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def low(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("n").agg(F.min("m").alias("low"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen, now = None, state(edges)
    while now != seen:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        lows = low(both).select("n", F.least("n", "low").alias("low"))
        # large star: every higher neighbour of n is linked to n's lowest
        large = both.where("m > n").join(lows, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: every lower neighbour of n, and n, are linked to n's lowest
        lows = low(large.select(F.col("u").alias("n"), F.col("v").alias("m")))
        met = large.join(lows, large["u"] == lows["n"]).select("u", "v", "low")
        small = met.select(F.col("v").alias("u"), F.col("low").alias("v")).union(met.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before)
        seen, now = now, state(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out = materialize(roots, "roots")
    discard(edges)
    return out
