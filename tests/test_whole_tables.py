"""Range queries over whole tables, against brute force."""

from pathlib import Path

import duckdb

from marlspike.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def read(sql):
    return duckdb.sql(sql).fetchall()


def spans():
    return [(c, c, c + 1 + (c % 40) * (c % 7)) for (c,) in read(f"select c_custkey from '{DATA}/customer.parquet'")]


def test_affected_has_every_commit(spark):
    writes = read(f"select o_orderkey, o_custkey from '{DATA}/orders.parquet'")
    want = {(o, i) for o, k in writes for i, low, high in spans() if low <= k < high}
    got = [(r.commit_ts, r.sub_id) for r in QUERIES["range_affected"](spark, str(DATA)).collect()]
    assert max(o for o, _ in want) >= 500 and sorted(got) == sorted(want)


def test_union_covers_every_subscription(spark):
    nation = dict(read(f"select c_custkey, c_nationkey from '{DATA}/customer.parquet'"))
    want, last = [], {}
    for i, low, high in sorted(spans(), key=lambda s: s[1:]):
        space = f"nation:{nation[i]}"
        if space in last and last[space][2] >= low:
            last[space][2] = max(last[space][2], high)
        else:
            last[space] = [space, low, high]
            want.append(last[space])
    got = [[r.keyspace, r.low, r.high] for r in QUERIES["range_union_spaces"](spark, str(DATA)).collect()]
    assert len(want) > 25 and sorted(got) == sorted(want)
