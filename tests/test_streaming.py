import pytest
from pyspark.sql import functions as F

from marlspike.operators import windows
from marlspike.session import scratch_path
from marlspike.sources import log as doclog
from marlspike.streaming import feed

LOG = "table_id string, doc_id long, ts long, value struct<a: double, b: string>"
ROWS = [("t", 1, 1, (1.0, "x")), ("t", 2, 2, (2.0, None)), ("t", 1, 3, None), ("t", 1, 5, (None, None)), ("u", 1, 6, (3.0, "y")), ("t", 2, 7, (4.0, "z")), ("t", None, 8, (5.0, "n"))]


def revisions(spark, *parts):
    path = scratch_path(spark, "revisions")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, files, out, cursor, handler=None):
    stream = feed.change_feed(feed.table_stream(spark, path, spark.createDataFrame([], LOG).schema, files))
    query = feed.drive(stream, handler or feed.into(out), cursor)
    query.awaitTermination()
    return stream.schema


@pytest.mark.parametrize("files", [1, 10])
def test_stream_equals_batch(spark, files):
    """Any split into batches gives the batch feed; a redelivered revision gives nothing more."""
    path, out = revisions(spark, ROWS[:3], ROWS[2:5], ROWS[5:]), scratch_path(spark, "out")
    schema = run(spark, path, files, out, scratch_path(spark, "cursor"))
    names = ["table_id", "doc_id", "ts", "prev_ts", "op", "change_id", "value", "old_value"]
    got = feed.written(spark, out, schema).select(*names).collect()
    want = doclog.changes(spark.createDataFrame(ROWS, LOG)).select(*names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_commits_out_of_order_stop_the_stream(spark):
    """A batch with a revision older than the document's last is an error, not a loss."""
    path = revisions(spark, [("t", 1, 10, (1.0, "x"))], [("t", 1, 5, (2.0, "y"))])
    with pytest.raises(Exception, match="out of order"):
        run(spark, path, 1, scratch_path(spark, "out"), scratch_path(spark, "cursor"))


def test_failing_batch_comes_again(spark):
    path, out, cursor, tries = revisions(spark, ROWS), scratch_path(spark, "out"), scratch_path(spark, "cursor"), []

    def fails(batch, batch_id):
        tries.append(batch_id)
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        run(spark, path, 10, out, cursor, fails)
    assert tries == [0] * 8
    schema = run(spark, path, 10, out, cursor)  # the cursor has not moved
    assert feed.written(spark, out, schema).count() == len(ROWS)


def test_anchored_windows(spark):
    times = [0, 5, 9, 9, 10, 25, 26, 30, 34, 35, None]
    rows = [(k, t, i) for k in ("a", None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, t long, place_ long")
    got = windows.rate_limit(df, ["k"], "t", 2, 10, ["place_"]).where("k is null").orderBy("place_").collect()
    assert [r.window_start for r in got] == [0, 0, 0, 0, 10, 25, 25, 25, 25, 35]
    assert [r.admitted for r in got] == [True, True, False, False, True, True, True, False, False, True]
    assert windows.breaker(df, ["k"], "t", 3, 10).where("tripped").count() == 4
    assert windows.rate_limit(df, ["k"], "t", 0, 10).where(~F.col("admitted")).count() == 0
    assert windows.rate_limit(df.limit(0), ["k"], "t", 1).count() == 0
