"""Pinned values, and small tables against plain Python, of what queries with SQL of their own cannot pin."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlspike.functions import hashing, types
from marlspike.operators import incremental, jobs, prefix, ranges
from marlspike.plans.predicates import Relation, Schema, restrict
from marlspike.session import discard, left_over, materialize, remove
from marlspike.sources import log as doclog

ROOT = Path(__file__).resolve().parents[1]


def fnv32(units):
    h = 0x811C9DC5
    for b in units:
        h = (h ^ b) * 0x01000193 % 2**32
    return h


def test_key_bytes():
    assert hashing.encode_key(["a\0b"]) == b"\x06a\0\xffb\0"
    assert hashing.encode_key([None, True, 1]) == b"\x01\x03\x05\x80\0\0\0\0\0\0\x01"
    assert hashing.encode_key([1.0]) == b"\x04\xbf\xf0\0\0\0\0\0\0"
    assert hashing.encode_key(["", "a"]) == b"\x06\0\x06a\0"
    assert hashing.to_tagged(-0.0) == 0.0 and "$float" in hashing.to_tagged(float("inf"))
    assert hashing.successor(b"a") == b"a\0" and hashing.range_end(b"a") > b"a\xfe"


def test_shards_do_not_hang_on_neighbours(spark):
    keys = [*range(1, 6), None, 2**62]
    for rows in (keys, keys[:5], [None]):
        df = spark.createDataFrame([(k,) for k in rows], "k long").coalesce(1)
        got = {r.k: r.s for r in df.select("k", hashing.shard_of(F.col("k"), 8).alias("s")).collect()}
        for k, s in got.items():
            slot = hashing.jump_hash(hashing.fnv(hashing.encode_key([k]), hashing.FNV64, hashing.FNV64_PRIME, 64), 8)
            assert s == hashing.shard_name(slot)
    text = spark.createDataFrame([("a",), (None,)], "k string").select(hashing.shard_of(F.col("k"), 4).alias("s")).collect()
    assert all(r.s in {"default", "s1", "s2", "s3"} for r in text)


def test_checksum_takes_low_bytes(spark):
    rows = [("dé", 3, "ü漢"), ("x", 10, None), ("y", 1, "")]
    want = 0
    for key, ts, order in rows:
        low = lambda s: s.encode("utf-16-le")[::2]
        want ^= fnv32(low(key) + b"\0" + str(ts).encode() + b"\0" + low(order or ""))
    df = spark.createDataFrame(rows, "k string, ts long, o string")
    assert incremental.checksum(df, F.col("k"), F.col("ts"), F.col("o")).first()[0] == f"{want:08x}"
    assert incremental.checksum(df.limit(0), F.col("k"), F.col("ts"), F.col("o")).first()[0] == "00000000"


def test_statuses_rise(spark):
    rows = [(1, "delivered", 1), (1, "bounced", 2), (2, "bounced", 1), (2, "delivered", 2), (3, "clicked", 1), (3, "opened", 2), (4, "complained", 5), (4, "dropped", 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "message_id int, status string, ts int, seq int")
    got = {r.message_id: (r.status, r.complained_at) for r in jobs.settle_status(df).collect()}
    assert got == {1: ("delivered", None), 2: ("delivered", None), 3: ("clicked", None), 4: ("complained", 5)}


def test_candidate_keys(spark):
    asks = ["admin", "a:b", "a:b:c", ":x", "*:*"]
    df = spark.createDataFrame([(p,) for p in asks], "p string").select("p", jobs.candidate_keys(F.col("p")).alias("k"))
    got = {r.p: r.k for r in df.collect()}
    assert got == {"admin": ["admin:", "admin:*", "*:", "*:*"], "a:b": ["a:b", "a:*", "*:b", "*:*"], "a:b:c": ["a:b:c", "a:*", "*:b:c", "*:*"], ":x": [":x", ":*", "*:x", "*:*"], "*:*": ["*:*"]}


def test_a_global_grant_holds_everywhere(spark):
    grants = spark.createDataFrame([("u", "", "", "a:*"), ("v", "global", "global", "a:*")], "user_id string, scope_type string, scope_id string, permission string")
    asks = spark.createDataFrame([("u", "org", "1", "a:b"), ("v", "org", "1", "a:b"), ("u", "", "", "a:b")], grants.schema)
    assert {(r.user_id, r.scope_type): r.granted for r in jobs.can(asks, grants).collect()} == {("u", "org"): True, ("v", "org"): False, ("u", ""): True}


JOB = "job_id int, state string, kind string, next_ts double, attempts int, max_failures int, lease_expires double, completed_ts double"


def test_job_transitions(spark):
    rows = [(1, "inProgress", "mutation", 5.0, 0, 3, 9.0, None), (2, "inProgress", "mutation", 4.0, 2, 3, 9.0, None), (3, "inProgress", "action", 3.0, 0, 3, 9.0, None), (4, "inProgress", "mutation", 1.0, 0, 3, 99.0, None), (5, "pending", "mutation", 1.0, 0, 3, None, None)]
    df = spark.createDataFrame(rows, JOB)
    assert [r.job_id for r in jobs.expired_leases(df, 10.0, 2).collect()] == [3, 2]
    got = {r.job_id: r for r in jobs.reclaim(df, 10.0).collect()}
    assert {k: r.state for k, r in got.items()} == {1: "pending", 2: "failed", 3: "failed", 4: "inProgress", 5: "pending"}
    assert (got[1].next_ts, got[1].attempts, got[1].lease_expires, got[1].completed_ts) == (10.0, 1, None, None)
    assert (got[3].attempts, got[3].completed_ts, got[4].lease_expires) == (1, 10.0, 99.0)
    done = {r.job_id: r for r in jobs.complete(df, spark.createDataFrame([(4,), (5,), (77,)], "job_id int"), 7.0).collect()}
    assert (done[4].state, done[4].lease_expires, done[4].completed_ts, done[5].state) == ("success", None, 7.0, "pending")
    wait = spark.range(1).select(*[jobs.backoff(F.lit(a), 250, 2, F.lit(r)).alias(f"w{a}") for a, r in ((1, 0.0), (2, 1.0))]).first()
    assert (wait.w1, wait.w2) == (500, 2000)
    f = jobs.fail(df, df.where("job_id = 1").select("job_id"), 0.0, random=F.lit(0.0)).where("job_id = 1").first()
    assert f.next_ts == 500 and f.attempts == 1


def test_stab_takes_any_key(spark):
    top, low = 2**63 - 1, -(2**63)
    spans = [(1, "t", low, None), (2, "t", low, top), (3, "t", 0, None), (4, "t", top, None), (5, "t", 5, 5), (6, "u", 0, None), (7, "t", low, low + 1)]
    points = [("t", k) for k in (low, -1, 0, 5, top - 1, top)] + [("w", 1)]
    draw = random.Random(1)
    spans += [(10 + i, "t", a := draw.randrange(low, top), draw.choice([None, draw.randrange(a, top)])) for i in range(40)]
    points += [("t", draw.randrange(low, top)) for _ in range(60)]
    got = ranges.stab(spark.createDataFrame(points, "keyspace string, key long"), spark.createDataFrame(spans, "sub_id long, keyspace string, low long, high long"))
    want = sorted((k, i) for s, k in points for i, z, a, b in spans if z == s and k >= a and (b is None or k < b))
    assert sorted((r.key, r.sub_id) for r in got.collect()) == want


def test_range_sets(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), a := draw.randrange(300), draw.choice([None] + [a + draw.randrange(6)] * 60)) for _ in range(150)]
    want = []
    for space in "ab":
        run = None
        for low, high in sorted((a, 2**63 if b is None else b) for s, a, b in rows if s == space):
            if run and low <= run[2]:
                run[2] = max(run[2], high)
            else:
                run = [space, low, high]
                want.append(run)
    got = ranges.union_ranges(spark.createDataFrame(rows, "keyspace string, low long, high long").repartition(5)).collect()
    assert sorted((r.keyspace, r.low, 2**63 if r.high is None else r.high) for r in got) == sorted(map(tuple, want))
    pairs = [((0, 5), (5, 9), False), ((0, 6), (5, 9), True), ((0, None), (5, 9), True), ((7, None), (5, 7), False), ((7, None), (5, None), True)]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in pairs], "a long, b long, c long, d long")
    assert [r.x for r in df.select(ranges.intersects(*map(F.col, "abcd")).alias("x")).collect()] == [w for *_, w in pairs]
    tables = spark.createDataFrame([("table:x",), ("index:x:by_a",), ("index:y:by_b",)], "keyspace string")
    assert sorted(r.table_name for r in ranges.written_tables(tables).collect()) == ["x", "y"]


def test_running_totals(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.k: (r.s, r.p) for r in prefix.numbered(prefix.running(df, [F.col("k").desc()], F.col("v"), "s"), [F.col("k").desc()], "p").collect()}
    assert got == {k: (sum(v for j, v in rows if j >= k), 200 - k) for k, _ in rows}
    assert prefix.running(df.limit(0), [F.col("k")], F.col("v"), "s").collect() == []


def test_closures_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 3)], "src long, dst long")
    assert sorted(r.node for r in jobs.closure(spark, chain, [5]).collect()) == list(range(3, 41))
    tree = [(i, i - 1 if i % 50 else None) for i in range(1, 1000)] + [(2000, 2001), (2001, 2000), (3000, 77777), (None, 60)]
    df = spark.createDataFrame(tree, "job_id long, parent_id long")
    assert sorted(r.job_id for r in jobs.descendants(spark, df, 60).collect()) == list(range(60, 100))
    assert sorted(r.job_id for r in jobs.descendants(spark, df, 2000).collect()) == [2000, 2001]
    assert sorted(r.job_id for r in jobs.descendants(spark, df, 77777).collect()) == [3000, 77777]


def test_every_with_a_nested_leaf(spark):
    frames = {
        "o": spark.createDataFrame([(1,), (2,), (3,)], "ok int"),
        "l": spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, None)], "lk int, part int"),
        "p": spark.createDataFrame([(10, "x"), (11, "y")], "pk int, name string"),
    }
    s = Schema(frames, {"o": "ok", "l": "lk", "p": "pk"}, {"o": {"lines": Relation("l", "lk")}, "l": {"part": Relation("p", "part", False)}})
    every = lambda leaf: sorted(r.ok for r in restrict(s, "o", {"lines": {"every": {"part": {"is": leaf}}}}).collect())
    assert every({"name": "x"}) == [3]  # the line 1-11 fails, whatever its sibling with the same key
    assert every(True) == [1, 3]


def test_stored_tables_go(spark):
    df = materialize(spark.range(3), "gone")
    path = df._marlspike_path
    assert path in left_over(spark) and df.count() == 3
    discard(df)
    assert path not in left_over(spark)
    remove(spark, [path])  # nothing there any more


def test_batches_read_what_they_need(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["t", "_sys", "c/x", "u"]), draw.randrange(4), ts, draw.choice([None, (float(ts),)])) for ts in range(1, 80)]
    log = spark.createDataFrame(rows, "table_id string, doc_id int, ts long, value struct<a:double>")
    every = {(r.table_id, r.doc_id, r.ts): r for r in doclog.changes(log).collect()}
    got, end = doclog.read_log(log, 30, 25)
    assert end == 55
    assert [(r.table_id, r.ts) for r in got.collect()] == [(r[0], r[2]) for r in rows if 30 < r[2] <= 55 and r[0] in "tu"]
    for r in doclog.read_log(log, 30, 25, tables=["t", "_sys"])[0].collect():
        assert r.table_id in ("t", "_sys") and r.asDict() == every[r.table_id, r.doc_id, r.ts].asDict()


def test_log_writes_and_dumps(spark, tmp_path):
    log = spark.createDataFrame([("t", 1, 1, (1.0,)), ("t", 2, 2, (2.0,)), ("t", 1, 3, None)], "table_id string, doc_id int, ts long, value struct<a:double>")
    batch = spark.createDataFrame([("t", 3, 4, (1.0,), 0), ("t", 3, 4, (5.0,), 1)], "table_id string, doc_id int, ts long, value struct<a:double>, seq int")
    assert {(r.doc_id, r.value and r.value.a) for r in doclog.latest(doclog.write(log, batch)).collect()} == {(1, None), (2, 2.0), (3, 5.0)}
    with pytest.raises(ValueError):
        doclog.write(log, batch.withColumn("ts", F.lit(2).cast("long")).withColumn("doc_id", F.lit(2)))
    doclog.dump(log, str(tmp_path))
    docs, top = doclog.load_dump(spark, str(tmp_path))
    assert top == 3 and [(r.doc_id, r.value.a) for r in docs.collect()] == [(2, 2.0)]
    assert [r.value.a for r in doclog.get(log, 2).collect()] == [2.0] and doclog.get(log, 1).collect() == []


def test_calendar():
    ms = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000
    assert jobs.cron_next("*/15 * * * *", ms(2024, 2, 29, 23, 50)) == ms(2024, 3, 1)
    assert jobs.cron_next("0 0 29 2 *", ms(2024, 3, 1)) == ms(2028, 2, 29)
    assert jobs.cron_next("30 6 1 * *", ms(2024, 3, 1, 6, 30), back=True) == ms(2024, 3, 1, 6, 30)
    assert jobs.cron_next(jobs.every("weekly", 5, 9, 1), ms(2024, 3, 1)) == ms(2024, 3, 4, 9, 5)
    assert next(hashing.random_stream(0)) == pytest.approx(0.26642920868471265)
    assert hashing.stable_json({"b": [1, {"z": None, "a": "é"}], "a": True}) == '{"a":true,"b":[1,{"a":"é","z":null}]}'


def test_validation_and_ddl():
    v = {"type": "object", "fields": {"a": {"type": "number"}, "k": {"type": "union", "members": [{"type": "literal", "value": "x"}, {"type": "literal", "value": "y"}]}}}
    assert types.ddl("t", v, {"by_a": ["a"]}) == ['CREATE TABLE IF NOT EXISTS "t" ("_id" TEXT PRIMARY KEY, "_creationTime" REAL NOT NULL, "a" REAL, "k" TEXT)', 'CREATE UNIQUE INDEX IF NOT EXISTS "t_by_a" ON "t" ("a")']
    assert [p["path"] for p in types.problems(v, {"a": "s", "k": "z", "q": 1})] == ["a", "k", "q"]


def test_package_ships_from_any_folder(tmp_path):
    """Executors import the package from the archive, wherever the driver was started."""
    code = """
import sys; sys.path.insert(0, {root!r})
from marlspike.session import get_spark
spark = get_spark("away", "2", 2)
from marlspike.queries import QUERIES
for q in ("diff_checksum", "shard_of_key"):
    print(q, QUERIES[q](spark, "/root/testdata/sf0.001").count())
""".format(root=str(ROOT))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")}}, capture_output=True, text=True, timeout=300)
    assert "diff_checksum 1" in out.stdout and "shard_of_key" in out.stdout, out.stderr[-2000:]
