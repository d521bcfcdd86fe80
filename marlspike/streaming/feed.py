"""The change feed and its consumers as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files, at most `files` in a batch.

    The stream source takes a plain path for a folder; as a pattern, the path can also be a single file.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def change_feed(log: DataFrame) -> DataFrame:
    """Changes of a stream of revisions (table_id, doc_id, ts, value): op, old value, previous time and change id.

    The state is one revision per document. A batch holds whole commits, and commits have to come in order: a revision
    equal to the document's last is a redelivery and gives nothing, one older than that stops the query with an error,
    since its change can no longer be told from what came before. Files dealt in another order than that of their
    commits (after a compaction, say) are thus noticed, not lost. A document's revisions of one batch are sorted in
    memory; the size of a batch bounds them.
    """
    kinds = {f: log.schema[f].dataType for f in ("table_id", "doc_id", "value")}
    keys = f"table_id {kinds['table_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}"

    def follow(key, frames, state):
        rows = pd.concat(frames).sort_values("ts").drop_duplicates("ts")
        last_ts, last = state.get if state.exists else (None, None)
        if last_ts is not None:
            if int(rows["ts"].iloc[0]) < last_ts:
                raise ValueError(f"revision {rows['ts'].iloc[0]} of {key} comes after {last_ts}: commits out of order")
            rows = rows[rows["ts"] > last_ts]
        if not len(rows):
            return
        times, values = rows["ts"].tolist(), [v if isinstance(v, str) else None for v in rows["value"]]
        before, olds = [last_ts, *times[:-1]], [last, *values[:-1]]
        state.update((int(times[-1]), values[-1]))
        ops = ["delete" if v is None else "insert" if p is None else "update" for v, p in zip(values, before)]
        out = {"table_id": key[0], "doc_id": key[1], "ts": times, "value": values, "prev_ts": pd.array(before, "Int64"), "old_value": olds, "op": ops}
        yield pd.DataFrame(out)

    slim = log.select("table_id", "doc_id", "ts", F.to_json("value").alias("value"))
    out = slim.groupBy("table_id", "doc_id").applyInPandasWithState(
        follow, f"{keys}, ts long, value string, prev_ts long, old_value string, op string", "ts long, value string", "append", "NoTimeout"
    )
    for c in ("value", "old_value"):
        out = out.withColumn(c, F.from_json(c, kinds["value"]))
    return out.withColumn("change_id", F.concat_ws(":", "table_id", "doc_id", "ts"))


def drive(feed: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, failures: int = 8) -> StreamingQuery:
    """Hand each batch to `handler` at least once, in order.

    A failing batch is given again; after `failures` times in a row the query stops with its cursor unmoved, and a new
    start on the same checkpoint goes on from that batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, failures + 1):
            try:
                return handler(batch, batch_id)
            except Exception:
                if attempt == failures:
                    raise

    return feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def into(path: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, so that a batch given again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What `into` wrote."""
    return spark.read.schema(schema).parquet(path).drop("batch")
