import random

from marlspike.functions import hashing, types
from marlspike.operators import jobs, ranges
from marlspike.plans.query import decode_cursor, encode_cursor, over


def test_key_order_and_codecs():
    values = [None, False, True, float("-inf"), -1.5, 0.0, 2.0, float("inf"), -(2**63), -1, 0, 2**63 - 1, "", "a", "a\0", "b", b"", b"a"]
    keys = [hashing.encode_key([v]) for v in values]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    internal = bytes(range(16))
    assert hashing.parse_id(hashing.make_id(10_001, internal)) == (10_001, internal)
    assert hashing.from_tagged(hashing.to_tagged({"$a": [1, 2.5, b"x", None, "s"]})) == {"$a": [1, 2.5, b"x", None, "s"]}
    assert hashing.fnv(b"a") == 0xE40C292C
    for n in (2, 5, 9):  # a new bucket only takes keys, it never moves them elsewhere
        assert all(hashing.jump_hash(k, n + 1) in (hashing.jump_hash(k, n), n) for k in range(500))
    assert decode_cursor(encode_cursor([1, None, "x"])) == [1, None, "x"]


def test_validators():
    doc = {"type": "object", "fields": {"a": {"type": "number"}, "b": {"type": "string", "optional": True}}}
    assert not types.problems(doc, {"a": 1.0})
    assert [p["message"] for p in types.problems(doc, {"c": 1})] == ["missing", "unexpected field"]
    assert types.schema_changes({"t": doc}, {"t": {"type": "object", "fields": {"a": {"type": "string"}}}}) == ["t.a: type changed", "t.b: removed"]
    assert types.spark_type(doc).simpleString() == "struct<a:double,b:string>"


def test_pages_cover_everything(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 3])) for i in range(23)]
    q = over(spark.createDataFrame(rows, "id int, k int"), ["k"], ["id"])
    for direction in ("asc", "desc"):
        seen, cursor, more = [], None, True
        while more:
            page = q.order(direction).paginate(5, cursor)
            seen += [(r.id, r.k) for r in page.rows]
            cursor, more = page.next_cursor, page.has_more
        key = lambda r: (r[1] is not None, r[1] or 0, r[0])
        assert seen == sorted(rows, key=key, reverse=direction == "desc")
    capped = q.where("eq", "k", 3).paginate(5, max_scan=4)
    assert capped.scan_capped and capped.has_more and capped.rows == []


def test_stab_equals_brute_force(spark):
    draw = random.Random(4)
    spans = [(i, draw.randrange(1000), draw.choice([1, 3, 70, 5000, None])) for i in range(60)]
    spans = [(i, "t", a, None if w is None else a + w) for i, a, w in spans]
    points = [("t", draw.randrange(6000)) for _ in range(200)]
    got = ranges.stab(spark.createDataFrame(points, "keyspace string, key long"), spark.createDataFrame(spans, "sub_id long, keyspace string, low long, high long"))
    assert sorted((r.key, r.sub_id) for r in got.collect()) == sorted((k, i) for _, k in points for i, _, a, b in spans if k >= a and (b is None or k < b))


def test_calendar_and_graph(spark):
    assert jobs.cron_next("0 9 * * 1", 1_700_000_000_000) == 1_700_470_800_000 - 1_700_470_800_000 % 1000
    assert jobs.interval_runs(0, 10, 35, "fireAll") == [10, 20, 30] and jobs.interval_runs(0, 10, 35, "skip") == []
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert sorted(r.node for r in jobs.closure(spark, edges, [1]).collect()) == [1, 2, 3]


def test_routes(spark):
    routes = spark.createDataFrame([("GET", "/a", "prefix", 1), ("GET", "/a/b", "exact", 2), ("GET", "/a/", "prefix", 3)], "method string, pattern string, kind string, route_id int")
    asks = spark.createDataFrame([("GET", "/a/b"), ("GET", "/a/c"), ("POST", "/a")], "method string, path string")
    assert {(r.path, r.route_id) for r in jobs.match_route(asks, routes).collect()} == {("/a/b", 2), ("/a/c", 3)}
