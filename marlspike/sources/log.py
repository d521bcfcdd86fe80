"""The document log: append-only revisions (table_id, doc_id, ts, value, deleted) and what is read from it.

Every read is as of a timestamp. "Newest revision per document" is an arg-max aggregation, which combines on the map
side, so a document with very many revisions costs one row per task in the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marlspike.operators.prefix import numbered, running

KEY = ["table_id", "doc_id"]


def from_events(events: DataFrame, tombstone: str = "error") -> DataFrame:
    """A log over the events table: a document per user, `event_id` as commit time, a tombstone per error event."""
    return events.select(
        F.lit("events").alias("table_id"),
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("ts"),
        F.when(F.col("event_type") != tombstone, F.struct("event_type", "value", "props")).alias("value"),
    )


def upto(log: DataFrame, ts: int | None) -> DataFrame:
    return log if ts is None else log.where(F.col("ts") <= ts)


def latest(log: DataFrame, ts: int | None = None) -> DataFrame:
    """The newest revision of each document, tombstones included."""
    newest = upto(log, ts).groupBy(*KEY).agg(F.max_by(F.struct("ts", "value"), "ts").alias("r"))
    return newest.select(*KEY, "r.ts", "r.value")


def as_of(log: DataFrame, ts: int | None = None) -> DataFrame:
    """The live documents."""
    return latest(log, ts).where(F.col("value").isNotNull())


def get(log: DataFrame, doc_id, ts: int | None = None) -> DataFrame:
    """A document's newest revision, no row if it is deleted or absent. The filter reaches the scan."""
    return as_of(log.where(F.col("doc_id") == doc_id), ts)


def tail(log: DataFrame, low: int, high: int, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Revisions with low <= ts < high in log order, tombstones included."""
    keys = ["ts", *KEY]
    df = log.where((F.col("ts") >= low) & (F.col("ts") < high)).orderBy(*[F.col(k).desc() if descending else F.col(k) for k in keys])
    return df if limit is None else df.limit(limit)


def previous(log: DataFrame, asks: DataFrame) -> DataFrame:
    """For each (doc_id, at) the newest revision up to `at`: an as-of join. Asks without one have no row.

    Asks and revisions go into one window per document, so the join never forms pairs.
    """
    revisions = log.select("doc_id", "ts", F.lit(0).alias("ask"), F.lit(None).cast("long").alias("at"), F.struct("ts", "value").alias("r"))
    wanted = asks.select("doc_id", F.col("at").alias("ts"), F.lit(1).alias("ask"), "at", F.lit(None).cast(revisions.schema["r"].dataType).alias("r"))
    w = Window.partitionBy("doc_id").orderBy("ts", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = revisions.unionByName(wanted).withColumn("seen", F.last("r", ignorenulls=True).over(w))
    return met.where((F.col("ask") == 1) & F.col("seen").isNotNull()).select("doc_id", "at", F.col("seen.ts").alias("rev_ts"), F.col("seen.value").alias("value"))


def chain(log: DataFrame) -> DataFrame:
    """Each revision with the commit time of the one before it."""
    return log.withColumn("prev_ts", F.lag("ts").over(Window.partitionBy(*KEY).orderBy("ts")))


def changes(log: DataFrame) -> DataFrame:
    """The change feed: op, new and old value of every revision, and its stable change id.

    A tombstone is a delete, a first revision an insert, all else an update; a document that comes back after its
    deletion is an update without an old value.
    """
    w = Window.partitionBy(*KEY).orderBy("ts")
    df = log.withColumn("prev_ts", F.lag("ts").over(w)).withColumn("old_value", F.lag("value").over(w))
    op = F.when(F.col("value").isNull(), "delete").when(F.col("prev_ts").isNull(), "insert").otherwise("update")
    return df.withColumn("op", op).withColumn("change_id", F.concat_ws(":", "table_id", "doc_id", "ts"))


def read_log(log: DataFrame, after_ts: int, limit: int, stable: int | None = None, tables: list | None = None, hidden: tuple[str, ...] = ("_",)) -> tuple[DataFrame, int]:
    """(changes after `after_ts`, highest ts scanned): a batch that never ends inside a commit.

    Only changes of `tables` are given, if they are named; else all but those of system tables (a name that starts with
    one of `hidden`) and of component tables (a name with a slash). Rows that are left out count towards `limit`, and
    the batch's end moves past them.

    `limit` counts scanned rows; the batch holds whole commits whose rows fit, and the first one even if it does not.
    Nothing over the stable prefix is seen. A limit of 0 returns no change and the bound that could be read.
    """
    seen = log.where(F.col("ts") > after_ts)
    seen = seen if stable is None else seen.where(F.col("ts") <= stable)
    if limit == 0:
        top = seen.agg(F.max("ts")).first()[0]
        return changes(log).where(F.lit(False)), after_ts if top is None else top
    # Only the next limit + 1 rows in order can decide where the batch ends.
    near = seen.select("ts").orderBy("ts").limit(limit + 1).groupBy("ts").count().orderBy("ts").collect()
    total, end = 0, after_ts
    for i, r in enumerate(near):
        total += r["count"]
        if total > limit and i:
            break
        end = r["ts"]
    # Of the history only the newest earlier revision of the batch's documents is needed.
    batch = log.where((F.col("ts") > after_ts) & (F.col("ts") <= end))
    docs = batch.select(*KEY).distinct()
    earlier = latest(log.where(F.col("ts") <= after_ts).join(docs, KEY, "left_semi")).select(*log.columns)
    fed = changes(batch.unionByName(earlier)).where(F.col("ts") > after_ts)
    name = F.col("table_id").cast("string")
    system = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(h)) for h in hidden], F.contains(name, F.lit("/")))
    fed = fed.where(~system) if tables is None else fed.where(name.isin([str(t) for t in tables]))
    return fed.orderBy("ts", *KEY), end


def byte_cut(feed: DataFrame, budget: int, size: Column, order: list[str], group: str = "ts") -> DataFrame:
    """The prefix of whole commits whose sizes fit the budget; the first commit always stays."""
    per = feed.groupBy(group).agg(F.sum(size).alias("size"))
    fits = running(per, [F.col(group)], F.col("size"), "upto").where(F.col("upto") <= budget).select(group)
    first = per.agg(F.min(group).alias(group)).where(F.col(group).isNotNull())
    return feed.join(fits.union(first), group, "left_semi").orderBy(*order)


def count_live(log: DataFrame, ts: int | None = None) -> DataFrame:
    return as_of(log, ts).groupBy("table_id").agg(F.count("*").alias("n_docs"))


def max_timestamp(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("max_ts"))


def index_log(log: DataFrame, key: Column) -> DataFrame:
    """Index entries that each revision writes: the old key's deletion if the key changes, and the new key."""
    w = Window.partitionBy(*KEY).orderBy("ts")
    df = log.withColumn("key", F.when(F.col("value").isNotNull(), key)).withColumn("old_key", F.lag("key").over(w))
    moved = ~F.col("key").eqNullSafe(F.col("old_key"))
    gone = df.where(F.col("old_key").isNotNull() & moved).select(F.col("old_key").alias("key"), "ts", "doc_id", F.lit(True).alias("deleted"))
    fresh = df.where(F.col("key").isNotNull()).select("key", "ts", "doc_id", F.lit(False).alias("deleted"))
    return gone.union(fresh)


def index_scan(entries: DataFrame, log: DataFrame, ts: int, low=None, high=None) -> DataFrame:
    """Live documents by index key as of ts: newest entry per (key, document), joined to the newest document."""
    e = entries.where(F.col("ts") <= ts)
    e = e if low is None else e.where(F.col("key") >= low)
    e = e if high is None else e.where(F.col("key") < high)
    newest = e.groupBy("key", "doc_id").agg(F.max_by("deleted", "ts").alias("deleted")).where(~F.col("deleted"))
    return newest.drop("deleted").join(as_of(log, ts).select("doc_id", F.col("ts").alias("rev_ts"), "value"), "doc_id")


def write(log: DataFrame, batch: DataFrame, overwrite: bool = False, guards: list[Callable[[DataFrame], None]] = ()) -> DataFrame:
    """The log with a batch appended. A revision that is there raises, or gives way with `overwrite`; within the batch
    the last row (by column `seq`) wins. Each guard sees the batch first, in turn; one that raises ends the whole write."""
    key = [*KEY, "ts"]
    last = batch.groupBy(*key).agg(F.max_by("value", "seq").alias("value"))
    for guard in guards:
        guard(last)
    if overwrite:
        return log.join(last, key, "left_anti").unionByName(last)
    if not log.join(last, key, "left_semi").isEmpty():
        raise ValueError("a revision of the batch exists already")
    return log.unionByName(last)


def commit(log: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of (unit, table_id, doc_id, value) with commit times after the log's last, rising by unit.

    Units are numbered by their rank among distinct units; all go out in one append or none.
    """
    ranks = numbered(units.select("unit").distinct(), [F.col("unit")], "rank")
    base = log.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("base"))
    return units.join(ranks, "unit").crossJoin(F.broadcast(base)).select(*KEY, (F.col("base") + F.col("rank")).alias("ts"), "value")


def dump(log: DataFrame, path: str, version: int = 1) -> None:
    """A portable snapshot: newest live revisions as JSON lines, with format, version and frontier beside them."""
    top = log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]
    as_of(log).write.mode("overwrite").json(f"{path}/docs")
    spark = log.sparkSession
    head = json.dumps({"format": "marlspike-dump", "version": version, "frontier": top, "schema": log.schema.json()})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_dump(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(documents, frontier) of a dump; raises on another format or version."""
    from pyspark.sql.types import StructType

    head = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if head["format"] != "marlspike-dump" or head["version"] != 1:
        raise ValueError("not a dump of this version")
    schema = StructType.fromJson(json.loads(head["schema"]))
    return spark.read.schema(schema).json(f"{path}/docs"), head["frontier"]


def collect_garbage(segments: DataFrame, consumers: DataFrame, snapshot: int) -> DataFrame:
    """Segments that may go: those up to the snapshot and up to every consumer's position."""
    floor = consumers.agg(F.min("position").alias("floor"))
    return segments.crossJoin(F.broadcast(floor)).where(F.col("last_ts") <= F.least(F.lit(snapshot), F.coalesce("floor", F.lit(snapshot)))).drop("floor")


def stable_prefix(frontiers: DataFrame, shards: int) -> DataFrame:
    """The commit time up to which every shard is complete; 0 until all of them have reported."""
    return frontiers.agg(F.when(F.countDistinct("shard") >= shards, F.min("frontier")).otherwise(0).alias("stable_ts"))


def recent(entries: DataFrame, order: str, where: Column, most: int = 50, ring: int = 1000) -> DataFrame:
    """Newest entries that meet a condition, out of the last `ring` ones."""
    return entries.orderBy(F.col(order).desc()).limit(ring).where(where).orderBy(F.col(order).desc()).limit(most)
