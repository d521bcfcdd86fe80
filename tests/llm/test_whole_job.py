"""What operators must do for every row, at their production settings."""

import random

import numpy as np

from marlspike.llm import neardup, secrets


def test_no_near_pair_stays_apart(spark):
    """Pairs at similarity 0.80 to 0.85, at the pipeline's own setting."""
    draw, rows, sizes = random.Random(3), [], [(90, 90, 80), (100, 80, 80), (270, 270, 240), (92, 92, 84)]
    for i in range(1000):
        na, nb, both = sizes[i % len(sizes)]  # shingles of each text, and those of both; 80 % of the union or more
        words = lambda n: [f"w{draw.getrandbits(40):x}" for _ in range(n)]
        shared = words(both + 4)
        rows += [(2 * i, " ".join(shared + words(na - both))), (2 * i + 1, " ".join(shared + words(nb - both)))]
    got = {r.row: r.group for r in neardup.groups_of(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert [i for i in range(1000) if got[2 * i] != 2 * i or got[2 * i + 1] != 2 * i] == []


def test_bounds_drop_no_alike_pair():
    """The embedding's distance never exceeds the sets' difference, and alike sets share a shingle of their prefixes."""
    draw = np.random.default_rng(5)
    for _ in range(3000):
        n = int(draw.integers(1, 400))
        x = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(draw.integers(0, n // 4 + 1))
        y = np.unique(np.r_[x[gone:], draw.integers(0, 2**63, int(draw.integers(0, n // 5 + 1)), dtype=np.uint64)])
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        far = len(x) + len(y) - 2 * both
        size = np.array([len(x), len(y)])
        vector = neardup.unpacked([np.array(w, np.uint64) for w in zip(neardup.embedding(x), neardup.embedding(y))])
        assert np.abs(vector[0].astype(int) - vector[1].astype(int)).sum() <= far
        assert neardup.fine_distance(neardup.fine_embedding(x), neardup.fine_embedding(y)) <= far
        if len(y) and both >= 0.8 * (len(x) + len(y) - both):
            assert neardup.in_range(size, vector, np.array([0]), np.array([1]), 0.8)[0]
            assert set(x[: neardup.prefix_length(len(x), 0.8)].tolist()) & set(y[: neardup.prefix_length(len(y), 0.8)].tolist())


def test_entropy_tokens_of_any_length():
    draw = random.Random(9)
    token = lambda n: "aZ3" + "".join(draw.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789", k=n - 3))
    for value in (token(20), token(300), ".".join([token(36), token(80), token(43)])):
        for before, after in (("", ""), ("see ", "."), ("(", ")... more"), ("...", ", x")):
            found = [s[:3] for s in secrets.scan(before + value + after)]
            assert found == [(3, len(before), len(before) + len(value))]
