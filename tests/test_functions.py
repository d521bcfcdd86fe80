"""Named functions, values of any type in order, guards, key-value writes, relational tables and files."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from marlspike.functions import hashing
from marlspike.plans.functions import Context, Registry
from marlspike.sources import external, tables
from marlspike.sources import log as doclog

LOG = "table_id string, doc_id int, ts long, value struct<a:int,created:long>"


def test_functions_validate_and_commit(spark):
    log = spark.createDataFrame([("t", 1, 1, (1, 1)), ("t", 2, 5, (2, 5))], LOG)
    r = Registry(valid=lambda c: F.col(f"{c}.a") < 10)

    @r.register("over", "query", {"least": {"type": "int64"}}, ["doc_id", "a"])
    def over(ctx, least):
        return ctx.db().select("doc_id", "value.a").where(F.col("a") >= least)

    @r.register("add", "mutation", {"n": {"type": "int64"}, "a": {"type": "int64", "optional": True}})
    def add(ctx, n, a=3):
        return ctx.spark.createDataFrame([("t", n + i, "insert", (a, 0), 0) for i in range(2)], "table_id string, doc_id int, op string, value struct<a:int,created:long>, seq int")

    ctx = Context(spark, log, 5, 0.0)
    assert [tuple(x) for x in r.query("over", ctx, least=2).collect()] == [(2, 2)]
    assert r.query("over", Context(spark, log, 4, 0.0), least=0).count() == 1
    after = r.mutate("add", ctx, 9, n=7)
    assert {x.doc_id: tuple(x.value) for x in doclog.as_of(after).collect()} == {1: (1, 1), 2: (2, 5), 7: (3, 9), 8: (3, 9)}
    for bad in (lambda: r.query("over", ctx, least="x"), lambda: r.mutate("add", ctx, 9, n=1), lambda: r.mutate("add", ctx, 9, n=7, a=10), lambda: r.query("over", ctx)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.query("add", ctx, n=1)
    assert [Context(spark, log, 1, 0.0, 4).random() for _ in range(2)] == [next(hashing.random_stream(4))] * 2


def compare(a, b):
    """The order of values, spelt out."""
    rank = lambda v: [v is None, isinstance(v, bool), isinstance(v, float), isinstance(v, int), isinstance(v, str), isinstance(v, bytes), isinstance(v, list), isinstance(v, dict)].index(True)
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if a is None:
        return 0
    if isinstance(a, list | dict):
        xs, ys = ([(x,) for x in v] if isinstance(v, list) else [(k, v[k]) for k in sorted(v, key=str.encode)] for v in (a, b))
        for x, y in zip(xs, ys):
            for p, q in zip(x, y):
                if c := compare(p, q):
                    return c
        return (len(xs) > len(ys)) - (len(xs) < len(ys))
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


def test_values_of_any_type_sort():
    draw = random.Random(6)

    def value(deep=0):
        kind = draw.randrange(8 if deep < 3 else 6)
        scalars = [None, draw.random() < 0.5, draw.uniform(-3, 3), draw.randrange(-4, 4), draw.choice(["", "a", "a\0", "ab", "é", "\U00010000", "￿"]), draw.choice([b"", b"\0", b"a"])]
        return scalars[kind] if kind < 6 else [value(deep + 1) for _ in range(draw.randrange(3))] if kind == 6 else {draw.choice("abé"): value(deep + 1) for _ in range(draw.randrange(3))}

    values = [value() for _ in range(400)]
    assert [hashing.order_key(v) for v in sorted(values, key=hashing.order_key)] == [hashing.order_key(v) for v in sorted(values, key=functools.cmp_to_key(compare))]


def test_guards_end_a_write(spark):
    log = spark.createDataFrame([("t", 1, 1, (1, 1))], LOG)
    batch = spark.createDataFrame([("t", 2, 2, (1, 1), 0)], LOG + ", seq int")
    seen = []

    def guard(rows):
        seen.append(rows.count())
        if len(seen) == 2:
            raise RuntimeError("no")

    assert doclog.write(log, batch, guards=[guard]).count() == 2
    with pytest.raises(RuntimeError):
        doclog.write(log, batch, guards=[guard])


def test_key_values(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    writes = spark.createDataFrame([("a", "x", 1), ("c", "y", 1), ("c", "z", 2)], "key string, value string, seq int")
    rows = lambda df: {r.key: (r.value, r.inserted) for r in df.collect()}
    assert rows(tables.put_globals(known, writes)) == {"a": ("x", False), "b": ("2", False), "c": ("z", True)}
    assert rows(tables.put_globals(known, writes, if_absent=True)) == {"a": ("1", False), "b": ("2", False), "c": ("y", True)}


def test_relational_round_trip(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:stores;create=true"
    df = spark.createDataFrame([(i, i % 2 == 0, 2**40 + i, i / 2, f"s{i}", [i, i]) for i in range(20)], "k int, b boolean, n long, d double, s string, l array<int>")
    external.write_jdbc(df, url, "docs", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = external.read_jdbc(spark, url, "docs", df.schema, ("k", 0, 20, 3), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(back.collect()) == sorted(df.collect()) and back.rdd.getNumPartitions() == 3
    assert back.where("k = 3").first().n == 2**40 + 3


def test_files_and_their_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"0123456789")
    (tmp_path / "b.bin").write_bytes(b"")
    assert {(r.path.rpartition("/")[2], r.length) for r in external.files(spark, str(tmp_path), "*.bin").collect()} == {("a.bin", 10)}
    asks = spark.createDataFrame([("a.bin", 0, 3), ("a.bin", 8, 99), ("b.bin", 0, 5), ("a.bin", 20, 30), ("x", 0, 1)], "name string, low long, high long")
    got = {(r.name, r.low): bytes(r.bytes) for r in external.byte_ranges(spark, str(tmp_path), asks).collect()}
    assert got == {("a.bin", 0): b"012", ("a.bin", 8): b"89", ("a.bin", 20): b""}
