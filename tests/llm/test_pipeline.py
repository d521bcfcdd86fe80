"""The pipeline's stages against brute force on a small table, and all operators on odd and empty tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlspike.llm import decontaminate, ranking, toxicity
from marlspike.llm.labels import remainder
from marlspike.llm.queries import QUERIES, held_out_scores, tokenizer_path
from marlspike.llm.text import folded_words
from marlspike.session import materialize, scratch_path, table

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage received and returned."""
    docs, seen = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, DATA), "t")
        seen.append((docs.collect(), out.collect()))
        docs = out
    return seen


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_quality_drops_what_the_model_rejects(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    kept = ids(after)
    right = [labels[r.doc_id] == (r.doc_id in kept) for r in before if r.doc_id in labels]
    assert np.mean(right) > 0.95
    assert ids(corpus_pipeline.quality(spark, spark.createDataFrame(after, COLUMNS), DATA).collect()) == kept


def shingles(text, k=5):
    w = folded_words(text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_one_of_each_near_group_stays(stages):
    before, after = stages[1]
    sets, kept = [shingles(r.text) for r in before], ids(after)
    label = list(range(len(before)))
    alike = np.zeros((len(before), len(before)))
    for i in range(len(before)):
        for j in range(i):
            alike[i, j] = alike[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike[i, j] >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    left = Counter(label[i] for i, r in enumerate(before) if r.doc_id in kept)
    assert max(left.values()) == 1  # no group keeps two
    gone = [i for i, r in enumerate(before) if r.doc_id not in kept]
    assert all(alike[i].max() >= 0.8 for i in gone)  # only documents with a near copy go


def test_only_leaks_go(spark, stages):
    before, after = stages[2]
    items = [t for r in table(spark, DATA, "benchmark").collect() if (t := decontaminate.collapse(r.text or ""))]
    kept = ids(after)
    for r in before:
        text = decontaminate.collapse(r.text or "")
        exact = any(t in text for t in items)
        assert not (exact and r.doc_id in kept)
        if r.doc_id not in kept and not exact:  # then an item is there with a few edits: most of its words are
            assert any(len(set(t.split()) & set(text.split())) >= 0.7 * len(set(t.split())) for t in items)


def test_mix_and_shards(stages):
    from tokenizers import Tokenizer

    before, mixed = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    had, took = Counter(), Counter()
    for rows, total in ((before, had), (mixed, took)):
        for r in rows:
            total[r.source] += size(r.text)
    names = sorted((s for s in had if s is not None)) + [None] * (None in had)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:  # fill sources at their bound one after another, from scratch each time
        left = sum(had.values()) - sum(3 * had[s] for s in full)
        target = {s: 3 * had[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        if not (over := {s for s in names if s not in full and target[s] > 3 * had[s]}):
            break
        full |= over
    assert all(abs(took[s] - target[s]) <= 1 for s in names)
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in stages[4][1]) == want


@pytest.fixture(scope="module")
def tables(spark):
    """Folders with tables like the driver's: one with nulls, ties and repeats, one with empty tables."""
    long, item = "word " * 30_000, "this benchmark item has quite enough characters to be searched for"
    docs = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, long, "en", None, 1), (4, f"x {item} y", "en", "b", 1), (5, "password=abcdefgh1 b@c.de", "en", "b", 1), (5, "\n \t", "en", "b", 1)]
    data = {
        "documents": (docs, COLUMNS),
        "labels": ([(1, 0, 0), (2, None, None), (3, 1, 1), (4, 1, 0), (4, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string"),
        "conversations": ([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 0, "user", "a"), (2, 1, None, None)], "conv_id long, turn long, role string, text string"),
    }
    roots = scratch_path(spark, "odd"), scratch_path(spark, "empty")
    for name, (rows, schema) in data.items():
        for root, some in zip(roots, (rows, [])):
            df = spark.createDataFrame(some, schema)
            extra = [F.lit(0).alias(c) for c in ("fp", "row", "group", "score", "kept", "source_size", "_row", "low", "seq") if c not in df.columns]
            df.select("*", *extra).write.parquet(f"{root}/{name}.parquet")
    return roots, len(docs)


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_and_empty_tables(spark, tables, name):
    (odd, empty), n = tables
    got = QUERIES[name](spark, odd).collect()
    if name not in ("op4_decontaminate", "op10_chat", "pipeline"):
        assert len(got) == n
    elif name == "op4_decontaminate":
        assert {r.doc_id for r in got} == {4}
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("module", [ranking, toxicity])
def test_scores_without_labels(spark, tables, module):
    (odd, _), n = tables
    docs, labels = table(spark, odd, "documents"), table(spark, odd, "labels")
    model = module.train(docs, labels.limit(0), remainder(F.col("doc_id"), 4) != 2)
    got = held_out_scores(docs, model, module, 4, 2).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
