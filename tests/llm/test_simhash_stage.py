"""The near-duplicate stage links by SimHash fingerprints first; what they do not reach is found all the same."""

import corpus_pipeline
from marlspike.llm import neardup, simhash


def test_stage_links_by_fingerprints_and_verifies(spark, monkeypatch):
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    near = {1: words, 2: [*words[:399], "x"], 3: [*words[:390], "x"], 4: [*words[:200], "y", *words[201:]], 5: words[::-1]}
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in near.items()]
    found, verified, similar = [], [], neardup.similar
    links = simhash.print_links
    monkeypatch.setattr(simhash, "print_links", lambda *a: found.append(out := links(*a)) or found.append({tuple(r) for r in out.collect()}) or out)
    monkeypatch.setattr(neardup, "similar", lambda pairs, *a: verified.append({tuple(r) for r in pairs.collect()}) or similar(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 5]
    assert len(found) == 2 and found[1] and found[1] & verified[0]


def test_print_links_hold_together_what_is_in_reach(spark):
    marks = [0, 1, 3, 7, 0xFF00, 0xFF00, 0xFF03, -1, -9]
    got = [(r.u, r.v) for r in simhash.print_links(spark.createDataFrame(list(enumerate(marks)), "node long, fp long")).collect()]
    root = list(range(len(marks)))
    for _ in marks:
        for u, v in got:
            assert u > v and ((marks[u] ^ marks[v]) & 2**64 - 1).bit_count() <= 3
            root[u] = root[v] = min(root[u], root[v])
    assert root == [0, 0, 0, 0, 4, 4, 4, 7, 7]
