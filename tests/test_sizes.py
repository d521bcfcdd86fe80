"""Plans that hold at size: no join looks at every pair, no exploded table is broadcast, no table of pairs is shuffled."""

import random
import re

from pyspark.sql import functions as F

from marlspike.operators import jobs, ranges
from marlspike.sources import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strangers_equal_brute_force_without_all_pairs(spark):
    draw = random.Random(3)
    some = lambda: [(draw.choice([None, *"abcdefgh"]), draw.choice([None, *range(9)])) for _ in range(14)]
    for _ in range(3):
        own, theirs = some(), some()
        there = lambda x, y: None not in (*x, *y) and (x[0] == y[0]) != (x[1] == y[1])
        out = documents.strangers(*[spark.createDataFrame(t, "table_name string, number long") for t in (own, theirs)])
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len({*got}) and {*got} == {x for x in own if any(there(x, y) for y in theirs)}


def test_routes_never_broadcast_the_exploded_requests(spark, monkeypatch):
    asks = spark.range(300).select(F.lit("GET").alias("method"), F.concat(F.lit("/a/"), F.col("id").cast("string")).alias("path"))
    rows = [("GET", "/", "prefix", 1), ("GET", "/a/7", "prefix", 2), ("GET", "/a/7", "exact", 3), ("POST", "/a/7", "exact", 4)]
    routes = spark.createDataFrame(rows, "method string, pattern string, kind string, route_id int")
    want = {f"/a/{i}": 3 if i == 7 else 2 if str(i)[0] == "7" else 1 for i in range(300)}
    for few in (100, 2):
        monkeypatch.setattr(jobs, "FEW_ROUTES", few)
        out = jobs.match_route(asks, routes)
        assert "BuildLeft" not in plan(out) and ("BuildRight" in plan(out)) == (few == 100)
        assert {r.path: r.route_id for r in out.collect()} == want


def test_risen_tables_pair_up_without_a_shuffle_of_the_pairs(spark, monkeypatch):
    draw = random.Random(5)
    polls = [(draw.choice([None, *range(40)]), draw.choice([None, *"abcd"])) for _ in range(90)]
    subs = [(draw.choice([None, *range(50)]), draw.choice([None, *"abcde"]), *draw.choice([(None, None), (2, 5), (4, None)])) for _ in range(90)]
    writes = [(draw.choice([None, *range(40)]), draw.choice("abcde"), draw.randrange(8)) for _ in range(60)]
    holds = lambda low, high, k: low is None or (low <= k and (high is None or k < high))
    want = {(c, i) for c, s in polls for i, t, *_ in subs if s == t is not None} | {(c, i) for c, s, k in writes for i, t, low, high in subs if s == t and holds(low, high, k)}
    tables = spark.createDataFrame(subs, "sub_id long, keyspace string, low long, high long"), spark.createDataFrame(writes, "commit_ts long, keyspace string, key long"), spark.createDataFrame(polls, "commit_ts long, keyspace string")
    for block, few in ((4096, 100_000), (3, 1)):
        monkeypatch.setattr(ranges, "BLOCK", block)
        monkeypatch.setattr(ranges, "FEW_CLASSES", few)
        out = ranges.affected_at(*tables)
        top = [x for x in plan(out).splitlines() if re.match(r"[ :+-]*(Union|HashAggregate|Exchange)", x)]
        assert "Union" in top[0]
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len({*got}) and {*got} == want
