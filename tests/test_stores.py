"""Writes, stores, standing queries and transitions on small random histories, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from marlspike.functions import hashing
from marlspike.operators import incremental, mail, roles, standing, workflow
from marlspike.plans.query import Catalog, CursorError, decode_cursor, decode_position, encode_cursor, encode_position, over
from marlspike.session import scratch_path
from marlspike.sources import documents, segments, tables
from marlspike.sources import log as doclog

LOG = "table_id string, doc_id int, ts long, value struct<a:int,created:long>"


def history(draw, n, docs=8):
    return [("t", draw.randrange(docs), ts, draw.choice([None, (draw.randrange(20), 1), (draw.randrange(20), 1)])) for ts in range(1, n)]


def state(rows, upto=None):
    out = {}
    for _, d, ts, v in rows:
        if upto is None or ts <= upto:
            out[d] = v
    return {d: v for d, v in out.items() if v is not None}


def test_batches_of_writes(spark):
    draw = random.Random(1)
    for turn in range(3):
        rows = history(draw, 30)
        ops = [("t", draw.randrange(10), draw.choice(["insert", "replace", "delete"]), draw.choice([None, (draw.randrange(20), 7)]), i) for i in range(12)]
        log = spark.createDataFrame(rows, LOG)
        df = spark.createDataFrame(ops, "table_id string, doc_id int, op string, value struct<a:int,created:long>, seq int")
        judged = documents.judge(log, df, lambda c: F.col(f"{c}.a") < 18, lambda c: F.col(f"{c}.a") != 3, ["a"])
        got = {r.doc_id: r.refused for r in judged.collect()}
        now, last, want = state(rows), {d: (op, v) for _, d, op, v, _ in ops}, {}
        for d, (op, v) in last.items():
            writes = op != "delete"
            if op == "insert" and d in now:
                want[d] = "exists"
            elif op == "replace" and d not in now:
                want[d] = "missing"
            elif writes and (v is None or v[0] >= 18):
                want[d] = "invalid"
            elif (d in now and now[d][0] == 3) or (writes and v[0] == 3):
                want[d] = "forbidden"
            else:
                want[d] = None
        accepted = {d for d, r in want.items() if r is None}
        stays = {v[0] for d, v in now.items() if d not in accepted}
        fresh = {}
        for d in sorted(accepted):
            if last[d][0] != "delete":
                fresh.setdefault(last[d][1][0], d)
        for d in accepted:
            if last[d][0] != "delete" and (last[d][1][0] in stays or fresh[last[d][1][0]] != d):
                want[d] = "duplicate"
        assert got == want
        out = {r.doc_id: r.value for r in documents.revisions(judged, 99).collect()}
        for d, r in want.items():
            if r is None and last[d][0] == "delete":
                assert (d in out) == (d in now) and out.get(d) is None
            elif r is None:
                assert (out[d].a, out[d].created) == (last[d][1][0], 99 if last[d][0] == "insert" else now[d][1])
            else:
                assert d not in out
    assert documents.judge(log, df.limit(0)).collect() == []


def test_dump_needs_free_numbers(spark):
    log = spark.createDataFrame([("t", 1, 1, (1, 1))], LOG)
    docs = spark.createDataFrame([("t", 1, 1, (2, 1)), ("u", 5, 2, (3, 1))], LOG)
    numbers = spark.createDataFrame([("t", 10), ("u", 11)], "table_name string, number int")
    assert {(r.table_id, r.doc_id): r.value.a for r in documents.apply_dump(log, docs, numbers, numbers.limit(1)).collect()} == {("t", 1): 2, ("u", 5): 3}
    for bad in ([("x", 11)], [("t", 12)]):
        with pytest.raises(ValueError):
            documents.apply_dump(log, docs, numbers, spark.createDataFrame(bad, numbers.schema))


def test_segments_hold_the_log(spark):
    rows = history(random.Random(2), 40)
    log, root = spark.createDataFrame(rows, LOG), scratch_path(spark, "store")
    assert segments.read(spark, root, log.schema).collect() == []
    for upto in (10, 20, 20, 25):
        m = segments.append(log, root, upto)
    assert m["end"] == 25 and len(m["segments"]) == 3
    key = lambda r: (r.table_id, r.doc_id, r.ts, r.value and tuple(r.value))
    assert sorted(map(key, segments.read(spark, root, log.schema, 8, 22).collect())) == sorted(r for r in rows if 8 < r[2] <= 22)
    with pytest.raises(Exception, match="(?i)exist"):  # a writer that was overtaken
        segments.swap(spark, root, {**m, "version": m["version"] - 1}, m)
    segments.snapshot(spark, root, log.schema)
    assert len(segments.sweep(spark, root, m)) == 3
    segments.append(log, root, 39)
    got = {r.doc_id: tuple(r.value) for r in doclog.as_of(segments.read(spark, root, log.schema)).collect()}
    assert got == state(rows)
    replica, mark = segments.tail(log.where("ts <= 30"), root, log.schema, 30)
    assert mark == 39 and sorted(map(key, replica.collect())) == sorted(rows)
    assert segments.tail(replica, root, log.schema, 39)[1] == 39


def test_pages_follow_their_diffs(spark):
    """A page and a document, kept by diffs, equal what is computed anew at every commit."""
    rows = history(random.Random(3), 60)
    log = spark.createDataFrame(rows, LOG)
    feed, key = doclog.changes(log), (lambda c: F.col(f"{c}.a"))
    for after, upto, descending in ((3, 12, False), (12, 3, True), (None, 9, False), (8, None, False)):
        diffs = standing.page_diff(feed, key, after, upto, descending=descending).collect()
        held = {}
        for ts in range(1, 60):
            for d in diffs:
                if d.ts == ts:
                    assert (d.change == "add") == (d.doc_id not in held)
                    held.pop(d.doc_id, None) if d.change == "remove" else held.update({d.doc_id: d.row.a})
            low, high = (upto, after) if descending else (after, upto)
            inside = lambda a: (low is None or (a >= low if descending else a > low)) and (high is None or (a < high if descending else a <= high))  # noqa: B023,E731
            assert held == {d: v[0] for d, v in state(rows, ts).items() if inside(v[0])}
    subs = spark.createDataFrame([(100 + d, d) for d in range(9)], "sub_id int, doc_id int")
    held = {}
    for d in sorted(standing.by_id_diff(feed, subs).collect(), key=lambda r: r.ts):
        assert d.sub_id == 100 + d.doc_id and (d.change == "add") == (d.doc_id not in held)
        held.pop(d.doc_id, None) if d.change == "remove" else held.update({d.doc_id: tuple(d.row)})
    assert held == state(rows)


def test_pages_own_every_key_once(spark):
    keys = random.Random(4).sample(range(100), 37)
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    for direction in ("asc", "desc"):
        q = over(df, [], ["k"]).order(direction)
        pages = standing.owned(q.page_bounds(5)).collect()
        edges = sorted((r.page, r.after and r.after.k, r.upto and r.upto.k) for r in pages)
        for k in range(-1, 102):
            own = [p for p, a, u in edges if (a is None or (k > a if direction == "asc" else k < a)) and (u is None or (k <= u if direction == "asc" else k >= u))]
            assert len(own) == 1
        page = q.paginate(5)
        assert page.after is None and decode_cursor(page.upto) == [page.rows[-1].k]
        assert q.paginate(50).upto is None
        staged = spark.createDataFrame([(1000, "put"), (keys[0], "delete")], "k int, op string")
        seen = {r.k for r in q.over_staged(staged, "k").paginate(100).rows}
        assert seen == {*keys[1:], 1000}


def test_catalog(spark):
    ids = [hashing.make_id(7, bytes([i] * 16)) for i in range(3)]
    c = Catalog({"t": spark.createDataFrame([(i, n, n % 2) for n, i in enumerate(ids)], "id string, at int, k int")}, ("at", "id"), {"t": {"by_k": ("k",)}})
    assert [r.at for r in c.query("t").order("desc").take(2).collect()] == [2, 1] and c.query("t").take(0).collect() == []
    assert [r.at for r in c.query("t", "by_k").eq("k", 1).pinned("k").collect_frame().collect()] == [1]
    for bad in (lambda: c.query("t", "by_x"), lambda: c.query("u")):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: c.query("t", "by_k").pinned("k"), lambda: c.query("t").eq("k", 1).pinned("k"), lambda: c.get("t", "!"), lambda: c.get("t", ids[0][:-1])):
        with pytest.raises(ValueError):
            bad()
    assert [r.at for r in c.get("t", ids[1]).collect()] == [1] and c.get("t", ids[1], F.col("k") == 0).collect() == []
    assert c.get("t", hashing.make_id(7, bytes(16 * [9]))).collect() == []
    assert decode_position(encode_position("index", [1, None]), "index") == [1, None] and decode_position(encode_position("simple", 5), "simple") == 5
    for cursor, code in (("x!", "malformed"), (encode_position("simple", 5), "kind")):
        with pytest.raises(CursorError) as e:
            decode_position(cursor, "index")
        assert e.value.code == code
    assert c.query("t").diffable() == "range" and c.query("t").diffable(reads=2) is None
    assert encode_cursor([1]) and hashing.by_shard(c.frames["t"], "k", 1).select("shard").distinct().collect()[0].shard == "default"
    assert hashing.by_shard(c.frames["t"], "k", 4, "s9").count() == 0


def test_rows_of_the_relational_store(spark):
    df = spark.createDataFrame([(1, True, 2**60, 1.5, "x", ([1, 2], None)), (2, None, None, None, None, None)], "k int, b boolean, n long, d double, s string, o struct<l:array<int>,m:int>")
    cells = tables.to_row(df)
    assert [tuple(r) for r in cells.orderBy("k").collect()] == [(1, 1, str(2**60), 1.5, "x", '{"l":[1,2]}'), (2, None, None, None, None, None)]
    assert sorted(tables.from_row(cells, df.schema).collect()) == sorted(df.collect())
    assert [r.k for r in tables.by_index(df, {"b": None}, 5).collect()] == [2]
    staged = df.withColumn("op", F.lit("replace")).withColumn("s", F.lit("new"))
    assert [r.s for r in tables.overlay_query(df, staged.where("k = 2"), {}, 1, "k").collect()] == ["new"]


def test_sessions_and_clients(spark):
    t = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 6), (1, 3, 7, 8), (1, 4, 8, 9), (2, 1, 1, 2), (3, 1, None, 2)], "session int, seq int, start_version int, end_version int")
    assert {(r.session, r.seq): r.applies for r in standing.bracketed(t).collect()} == {(1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (2, 1): False, (3, 1): False}
    entries = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 50.0)], "fingerprint string, released_at double")
    assert sorted(r.fingerprint for r in standing.resumable(entries, 60.0, 20.0).collect()) == ["a", "c"]
    sums = lambda rows: spark.createDataFrame(rows, "sub_id int, checksum string")
    assert sorted(r.sub_id for r in standing.drifted(sums([(1, "a"), (2, "b"), (3, "c")]), sums([(1, "a"), (2, "x"), (4, "d")])).collect()) == [2, 3, 4]
    rows = spark.createDataFrame([("x", 2), ("y", None), ("z", 9), ("w", 2)], "key string, k int")
    assert [r.key for r in standing.render(rows, "k").collect()] == ["y", "w", "x", "z"] and [r.key for r in standing.render(rows, "k", True, 2).collect()] == ["z", "x"]
    assert tuple(standing.live_stats(rows, t).first()) == (4, 6)
    prefs = spark.createDataFrame([(1, "news", "email", False), (2, "news", None, True)], "user_id int, category string, channel string, enabled boolean")
    assert [tuple(r) for r in mail.preferences_of(prefs, 1).collect()] == [("news", "email", False)]
    sessions = spark.createDataFrame([("t1", 1, 10), ("t2", 1, 99)], "token string, user_id int, expires_at int")
    assert [r.token for r in mail.sessions_of(sessions, 1, 50).collect()] == ["t2"]
    flows = spark.createDataFrame([(1, "running", None, None)], "workflow_id int, state string, result string, error string")
    assert workflow.status(flows, 1).first().state == "running" and workflow.status(flows, 2).first() is None
    groups = spark.createDataFrame([(1, "a", "x")], "g int, k string, v string")
    assert incremental.fingerprints(groups, "g", ["k", "v"]).first().fingerprint == incremental.fingerprints(groups, "g", ["k", "v"]).first().fingerprint


def test_digests_are_marked(spark):
    items = spark.createDataFrame([("u", "a", 1, 1, None), ("u", "a", 5, 2, None), ("u", "b", 1, 3, None), ("v", "a", 9, 4, None), ("u", "a", 0, 5, 7)], "recipient string, category string, created_at long, item_id int, flushed_at long")
    windows = spark.createDataFrame([("a", 5)], "category string, window long")
    due = mail.digest_groups(items, windows, 10)
    assert [tuple(r) for r in due.collect()] == [("u", "a", 1)]
    marked, sent = mail.flush(items, due, 10)
    assert {r.item_id: r.flushed_at for r in marked.collect()} == {1: 10, 2: 10, 3: None, 4: None, 5: 7}
    assert [([i.item_id for i in r["items"]], r.idempotency_key) for r in sent.collect()] == [([1, 2], "digest:u:a:1")]


def test_receipts_and_floors(spark):
    receipts = spark.createDataFrame([("i", 1, s, s * 10) for s in range(1, 6)] + [("i", 2, 9, 0)], "identity string, client_id int, seq int, created_at int")
    floors = spark.createDataFrame([("i", 1, 4)], "identity string, client_id int, floor int")
    acked = spark.createDataFrame([("i", 1, 2), ("i", 3, 8)], "identity string, client_id int, acked_through int")
    left, raised = mail.prune_receipts(receipts, floors, acked, 5)
    assert sorted((r.client_id, r.seq) for r in left.collect()) == [(1, 3), (1, 4), (1, 5)]
    assert {r.client_id: r.floor for r in raised.collect()} == {1: 4, 2: 9, 3: 8}


def test_roles(spark):
    inherits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "ghost"), ("e", "d")], "role string, parent string")
    grants = spark.createDataFrame([("a", "x", "read"), ("c", "y", "*"), ("d", "z", "w")], "role string, resource string, action string")
    got = {}
    for r in roles.expand(spark, inherits, grants).collect():
        got.setdefault(r.role, set()).add(r.pattern)
    assert got == {"a": {"x:read", "y:*"}, "b": {"x:read", "y:*"}, "c": {"x:read", "y:*"}, "d": {"z:w"}, "e": {"z:w"}}
    text = '{"permissions":{},"roles":{"é":{"r":["a"]}}}'
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 % 2**32
    assert roles.config_hash({"é": {"r": ["a"]}}, {}) == f"{h:x}" and roles.data_hash("a") == 0xE40C292C


def test_replay_stops_where_it_must(spark):
    step = "workflow_id int, step_number int, kind string, name string, args string"
    asks = spark.createDataFrame([(w, i, "mutation", f"f{i}", "{}") for w in range(1, 6) for i in range(3)], step)
    journal = spark.createDataFrame(
        [(w, i, "mutation", f"f{i}", "{}", "success", None) for w in (1, 2) for i in range(3 if w == 1 else 1)]
        + [(3, 0, "mutation", "other", "{}", "success", None), (4, 0, "mutation", "f0", "{}", "failed", "boom"), (5, 0, "mutation", "f0", "{}", "pending", None)],
        step + ", state string, error string",
    )
    got = {r.workflow_id: (r.outcome, r.at_step, r.new_step, r.error) for r in workflow.replay(asks, journal).collect()}
    assert got == {1: ("completed", None, None, None), 2: ("suspended", 1, "f1", None), 3: ("mismatch", 0, None, None), 4: ("failed", 0, None, "boom"), 5: ("suspended", 0, None, None)}


def test_events_are_received_once(spark):
    events = spark.createDataFrame([(1, "go", 1, "waiting", None), (1, "go", 2, "waiting", None), (2, "go", 3, "received", "old")], "workflow_id int, name string, event_id int, state string, payload string")
    steps = spark.createDataFrame([(1, 0, "waitForEvent", "go", "pending", None), (1, 1, "mutation", "go", "pending", None)], "workflow_id int, step_number int, kind string, name string, state string, result string")
    sent = spark.createDataFrame([(1, "go", "second", 2), (1, "go", "first", 1), (2, "go", "x", 1), (9, "go", "x", 1)], "workflow_id int, name string, payload string, seq int")
    rows, after = workflow.send_events(events, steps, sent)
    assert {r.event_id: (r.state, r.payload) for r in rows.collect()} == {1: ("received", "first"), 2: ("waiting", None), 3: ("received", "old")}
    assert {r.step_number: (r.state, r.result) for r in after.collect()} == {0: ("success", "first"), 1: ("pending", None)}
