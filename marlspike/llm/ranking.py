"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has a strength, a sum of one weight per binned text statistic. A pair of a good and a bad labelled
document is won by the good one with probability sigmoid(strength difference); the weights minimise the logistic loss
over all pairs (Newton's method, ridge penalty), which weigh as much together as `rivals` pairs for each document of the
rarer class. The strength that as many labelled documents stay under as are bad is the threshold. Labels, language,
source and identifier are no features.

Fitting takes every labelled row, in passes that sum integers over a written table, so the order of rows does not
matter and the driver holds sums of fixed size: bin edges are exact quantiles, found a byte of the number at a time, and
the losses of all pairs follow from how many documents of each class stand at each of `PLACES` strengths (a strength
between two counts for both, so a sum over pairs is that of a curve read off by straight lines). Scoring is one narrow
pass over whole texts, without a shuffle.

Defined cases: null and empty texts have the statistics of an empty text and a score like any other; repeated rows
score alike, and count once in fitting (of rows with one identifier that with the lowest hash of its text); a document
labelled twice counts once, with its highest label; without labels of both classes every score is 0.5; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marlspike.llm import stats
from marlspike.llm.labels import squash
from marlspike.llm.text import texts_of
from marlspike.session import RECORDS, discard, materialize, settings, ship

BINS, FEATURES = 10, 14
QUANTILES = (0.001, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 0.999)
#: Strengths that pairs are counted at, parts that a document is split in between two of them, parts of a fixed-point weight.
PLACES, PARTS, FIXED = 512, 256, 1 << 24
#: Rows that a pass takes at a time, and rows of a task: a task gives its sums once, so few tasks give few rows.
CHUNK, TASK = 65_536, 262_144
#: From labels (0 or 1), values and how often each row counts to (keys, integers), for one chunk of rows.
Tally = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def features(text: str) -> list[float]:
    s = stats.of(text)
    w, c = max(1, s.n_words), max(1, s.word_chars)
    return [np.log1p(s.n_words), s.word_chars / w, s.upper / max(1, s.letters), s.letters / c, s.n_symbols / w, s.bangs / w, s.punct / w, s.digits / c, s.n_dup_lines / max(1, s.n_lines), s.n_repeat_words / w, s.distinct / w, s.adjacent / w, s.commonest / w, s.n_lines / w]


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features * BINS,)
    threshold: float
    scale: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def one_hot(self, x: np.ndarray) -> np.ndarray:
        hot = np.zeros((len(x), len(self.edges), BINS), np.float32)
        np.put_along_axis(hot, self.bins(x)[:, :, None].astype(np.int64), 1, axis=2)
        return hot.reshape(len(x), -1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.scale == 0:
            return np.full(len(x), 0.5)
        return squash(self.one_hot(x) @ self.weights, self.threshold, self.scale)


class Rows:
    """Labelled rows that are here."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.y, self.x = y, x

    def sums(self, tally: Tally, size: int) -> np.ndarray:
        """The tallies of all rows, summed by key, for keys from 0 to size."""
        keys, values = tally(self.y, self.x, np.ones(len(self.y), np.int64))
        out = np.zeros(size, np.int64)
        np.add.at(out, keys, values)
        return out

    def binned(self, model: Model) -> Rows:
        return Rows(self.y, model.bins(self.x))

    def close(self) -> None:
        """Nothing to delete."""


class WrittenRows:
    """Labelled rows in a written table (y int, x binary, n long: how often)."""

    def __init__(self, table: DataFrame, kind: str):
        self.table, self.kind = table.coalesce(max(1, -(-table.count() // TASK))), kind
        self.written = table

    def sums(self, tally: Tally, size: int) -> np.ndarray:
        kind = self.kind

        def tallies(batches):
            total, held, rows = np.zeros(size, np.int64), [], 0
            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= CHUNK:
                    add(total, held)
                    held, rows = [], 0
            if rows:
                add(total, held)
            keys = np.flatnonzero(total)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], ["at", "v"])

        def add(total, held):
            t = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(-1, FEATURES)
            keys, values = tally(t.column("y").to_numpy(), x, t.column("n").to_numpy())
            total[keys] += values

        with settings(self.table.sparkSession, {RECORDS: "10000"}):
            got = self.table.mapInArrow(tallies, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size, np.int64)
        out[got["at"].to_numpy()] = got["v"].to_numpy()
        return out

    def binned(self, model: Model) -> WrittenRows:
        """The rows with their bins for values, equal ones as one."""

        def bins(batches):
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, FEATURES)
                yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in model.bins(x)], pa.binary())], ["y", "x"])

        coded = self.written.select("y", "x").mapInArrow(bins, "y int, x binary")
        return WrittenRows(materialize(coded.groupBy("y", "x").agg(F.count("*").alias("n")), "binned"), "u1")

    def close(self) -> None:
        discard(self.written)


def summed_by_key(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One row for each key. The sums are of integers under 2**53 and so exact."""
    total = np.bincount(keys, weights=values, minlength=size).astype(np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the values."""
    bits = (np.ascontiguousarray(v, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def value_of(bits: int) -> float:
    return float(np.array(bits - 2**63 if bits >> 63 else ~bits % 2**64, np.uint64).view(np.float64))


def order_statistics(rows: Rows | WrittenRows, value: Callable[[np.ndarray, np.ndarray], np.ndarray], label: int | None, ranks: list[int], columns: int) -> np.ndarray:
    """(columns, ranks): the values at `ranks` (from 0) of the rows of a label, exactly, a byte of the number at a time."""
    prefix, left = np.zeros((columns, len(ranks)), object), np.tile(np.array(ranks, object), (columns, 1))
    for shift in range(56, -8, -8):
        starts = [np.array(sorted({*p}), np.uint64) for p in prefix]
        wide = len(ranks) * 256

        def tally(y, x, n, shift=shift, starts=starts, wide=wide):
            mine = slice(None) if label is None else y == label
            v, n, keys, values = value(y, x)[mine], n[mine], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for j, known in enumerate(starts):
                bits = ordered_bits(v[:, j])
                top = bits >> np.uint64(shift + 8) if shift < 56 else np.zeros(len(bits), np.uint64)
                at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                ok = known[at] == top
                keys.append((j * wide + at * 256 + (bits >> np.uint64(shift) & np.uint64(255)).astype(np.int64))[ok])
                values.append(n[ok])
            return summed_by_key(np.concatenate(keys), np.concatenate(values), columns * wide)

        counts = rows.sums(tally, columns * wide).reshape(columns, len(ranks), 256)
        for j in range(columns):
            for i in range(len(ranks)):
                upto = np.cumsum(counts[j, np.searchsorted(starts[j], np.uint64(prefix[j, i]))])
                digit = int(np.searchsorted(upto, left[j, i], side="right"))
                left[j, i] -= int(upto[digit - 1]) if digit else 0
                prefix[j, i] = prefix[j, i] * 256 + digit
    return np.array([[value_of(p) for p in row] for row in prefix])


def edges_of(rows: Rows | WrittenRows, goods: int) -> np.ndarray:
    """(features, BINS - 1): quantiles of the good documents, between two values by straight lines."""
    place = np.array(QUANTILES) * (goods - 1)
    low = np.floor(place).astype(int)
    ranks = sorted({*low.tolist(), *np.minimum(low + 1, goods - 1).tolist()})
    found = order_statistics(rows, lambda y, x: x, 1, ranks, FEATURES)
    a, b = found[:, [ranks.index(i) for i in low]], found[:, [ranks.index(min(i + 1, goods - 1)) for i in low]]
    return a + (b - a) * (place - low)


def strengths(w: np.ndarray, bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for j in range(FEATURES):
        out += w[j * BINS + bins[:, j].astype(np.int64)]
    return out


def newton_step(rows: Rows | WrittenRows, w: np.ndarray, per_pair: float, most: int, ridge: float) -> np.ndarray:
    """The step of Newton's method for the loss over all pairs, each weighing `per_pair`; classes have `most` rows or fewer."""
    by_feature = w.reshape(FEATURES, BINS)
    low, high = by_feature.min(1).sum() - 1e-6, by_feature.max(1).sum() + 1e-6
    width = (high - low) / (PLACES - 1)
    place = low + width * np.arange(PLACES)
    n_w = FEATURES * BINS

    def spot(x):
        """Each row's lower place, and of PARTS how many parts of it belong to the next."""
        at = np.clip((strengths(w, x) - low) / width, 0, PLACES - 1 - 1e-9)
        return at.astype(np.int64), np.rint((at - np.floor(at)) * PARTS).astype(np.int64)

    def held(y, x, n):
        at, parts = spot(x)
        first = (y.astype(np.int64) * PLACES + at) * n_w
        cells = [first + j * BINS + x[:, j] for j in range(FEATURES)]
        return summed_by_key(np.concatenate([*cells, *[c + n_w for c in cells]]), np.concatenate([n * (PARTS - parts)] * FEATURES + [n * parts] * FEATURES), 2 * PLACES * n_w)

    bad, good = rows.sums(held, 2 * PLACES * n_w).reshape(2, PLACES, n_w) / PARTS
    n_bad, n_good = bad[:, :BINS].sum(1), good[:, :BINS].sum(1)
    lost = 1 / (1 + np.exp(np.clip(place[:, None] - place[None], -500, 500)))  # of a good one there to a bad one there
    curve = lost * (1 - lost)
    slopes = np.stack([curve.T @ n_good, curve @ n_bad]) / most  # of a bad document, of a good one: a quarter at most

    def squares(y, x, n):
        at, parts = spot(x)
        weigh = slopes[y, at] + (slopes[y, at + 1] - slopes[y, at]) * parts / PARTS
        fixed = n * np.rint(weigh * FIXED).astype(np.int64)
        cells = [j * BINS + x[:, j].astype(np.int64) for j in range(FEATURES)]
        out = np.zeros(n_w * n_w, np.int64)
        for i in range(FEATURES):
            for j in range(i, FEATURES):
                out += np.bincount(cells[i] * n_w + cells[j], weights=fixed, minlength=n_w * n_w).astype(np.int64)
        found = np.flatnonzero(out)
        return found, out[found]

    upper = rows.sums(squares, n_w * n_w).reshape(n_w, n_w) * (most / FIXED)
    own = upper + np.triu(upper, 1).T
    cross = good.T @ curve @ bad
    gradient = per_pair * (bad.T @ (lost.T @ n_good) - good.T @ (lost @ n_bad)) + ridge * w
    return np.linalg.solve(per_pair * (own - cross - cross.T) + ridge * np.eye(n_w), gradient)


def fit_rows(rows: Rows | WrittenRows, rivals: int = 20, ridge: float = 1.0) -> Model:
    bads, goods = (int(v) for v in rows.sums(lambda y, x, n: summed_by_key(y.astype(np.int64), n, 2), 2))
    if not bads or not goods:
        return Model(np.zeros((FEATURES, BINS - 1)), np.zeros(FEATURES * BINS), 0.0, 0.0)
    # Edges come from the good documents: a bad one then falls into an outer bin of what gives it away.
    edges = edges_of(rows, goods)
    edges[:, 0] -= 1e-9
    w = np.zeros(FEATURES * BINS)
    binned = rows.binned(Model(edges, w, 0.0, 1.0))
    for _ in range(25):
        step = newton_step(binned, w, rivals / max(bads, goods), max(bads, goods), ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    # The threshold: midway between the best of as many as are bad and the next.
    cut = min(bads - 1, bads + goods - 2)
    between = order_statistics(binned, lambda y, x: strengths(w, x)[:, None], None, [cut, cut + 1], 1)
    binned.close()
    return Model(edges, w, float(between.mean()), 1.0)


def fit(rows: list[tuple[str, int]], rivals: int = 20, ridge: float = 1.0) -> Model:
    """Fit on (text, label) rows that are here."""
    x = np.array([features(r[0]) for r in rows], np.float64).reshape(-1, FEATURES)
    return fit_rows(Rows(np.array([r[1] for r in rows], np.int64), x), rivals, ridge)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts_of(texts)]).reshape(-1, FEATURES)), dtype="float64")

    return score(text)


def features_column(text: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t), np.float64).tobytes() for t in texts_of(texts)], dtype=object)

    return found(text)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model:
    """Fit on every labelled document whose label is usable. Statistics are taken before the join, so no text is shuffled."""
    ship(docs.sparkSession)
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counted = docs.where("doc_id is not null").select("doc_id", F.struct(F.xxhash64("text").alias("h"), features_column(F.col("text")).alias("x")).alias("r"))
    each = counted.groupBy("doc_id").agg(F.min("r").alias("r")).join(known, "doc_id")
    rows = WrittenRows(materialize(each.select("y", F.col("r.x").alias("x"), F.lit(1).cast("long").alias("n")), "statistics"), "f8")
    model = fit_rows(rows)
    rows.close()
    return model


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """`docs` without those scored under `least`; all columns stay as they are."""
    ship(docs.sparkSession)
    return docs.where(score_column(model, F.col(text_col)) >= least)
