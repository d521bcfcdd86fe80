"""The pairwise ranking is fitted on every labelled row, wherever the rows lie."""

import random

import numpy as np
from pyspark.sql import functions as F

from marlspike.llm import ranking


def texts(n, seed):
    draw = random.Random(seed)
    word = lambda good: draw.choice(["plain", "words", "of", "prose", "here", "and", "there"] if good or draw.random() < 0.6 else ["##", "$$", "!!", "BUY"])
    return [(" ".join(word(y) for _ in range(draw.randrange(1, 30))), y) for y in (int(draw.random() < 0.52) for _ in range(n))]


def test_training_takes_every_labelled_row(spark):
    rows = texts(4600, 1)
    assert min(sum(y for _, y in rows), sum(1 - y for _, y in rows)) > 2000
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(0, rows[0][0]), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(1, 0), (9999, 1), (None, 0)], "doc_id long, quality int")
    want = ranking.fit(rows)
    for n in (1, 7):
        got = ranking.train(docs.repartition(n, F.rand(n)), labels.repartition(n), F.lit(True))
        assert np.array_equal(got.edges, want.edges) and np.array_equal(got.weights, want.weights) and got.threshold == want.threshold


def test_edges_threshold_and_weights_equal_plain_ones():
    rows = texts(400, 2)
    model, x, y = ranking.fit(rows), np.array([ranking.features(t) for t, _ in rows]), np.array([v for _, v in rows])
    edges = np.quantile(x[y == 1], ranking.QUANTILES, axis=0).T
    edges[:, 0] -= 1e-9
    assert np.allclose(model.edges, edges, atol=1e-12)
    hot, few = model.one_hot(x).astype(float), min(sum(y), sum(1 - y))
    raw = hot @ model.weights
    bads = int((y == 0).sum())
    assert np.isclose(model.threshold, np.sort(raw)[bads - 1 : bads + 1].mean())
    lost = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0][None]))
    weight = 20 * few / lost.size
    gradient = weight * (hot[y == 0].T @ lost.sum(0) - hot[y == 1].T @ lost.sum(1)) + model.weights
    assert np.abs(gradient).max() < 0.01 * weight * lost.size / 20
    values = np.array([[-2.5, 0.0], [3.0, -0.0], [1e-300, 7.0], [-1e300, 2.0]])
    found = ranking.order_statistics(ranking.Rows(np.ones(4, int), values), lambda y, x: x, None, [0, 1, 2, 3], 2)
    assert np.array_equal(found, np.sort(values, axis=0).T)
