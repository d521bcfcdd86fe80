"""Incremental maintenance of standing query results: diffs, their application, checksums, and polls.

A change is (change, key, row, ts): add, edit or remove. A diff of two snapshots followed by its application equals
the recomputed snapshot; the tests hold random histories against that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlspike.functions.hashing import fnv1a32


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, row: str = "row") -> DataFrame:
    """(key, change, row) from two keyed snapshots; unchanged keys have no row."""
    b, a = before.select(F.col(key).alias("_bk"), F.col(row).alias("_b")), after.select(F.col(key).alias("_ak"), F.col(row).alias("_a"))
    both = b.join(a, b["_bk"] == a["_ak"], "full_outer")
    change = F.when(F.col("_bk").isNull(), "add").when(F.col("_ak").isNull(), "remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "edit")
    return both.select(F.coalesce("_ak", "_bk").alias(key), change.alias("change"), F.col("_a").alias(row)).where(F.col("change").isNotNull())


def membership_diff(feed: DataFrame, admits, key: str = "doc_id", old: str = "old_value", new: str = "value") -> DataFrame:
    """Row-level diffs straight from a change feed: a row enters, stays with an edit, or leaves what `admits` admits.

    `admits` makes a condition from the name of a struct column; a null struct is outside.
    """
    inside = lambda c: F.coalesce(F.col(c).isNotNull() & admits(c), F.lit(False))
    was, now = inside(old), inside(new)
    change = F.when(now & ~was, "add").when(was & ~now, "remove").when(was & now & ~F.col(old).eqNullSafe(F.col(new)), "edit")
    return feed.select(key, "ts", change.alias("change"), F.when(now, F.col(new)).alias("row")).where(F.col("change").isNotNull())


def net(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last change of each key."""
    return changes.groupBy(key).agg(F.max_by(F.struct("change", "row", "ts"), "ts").alias("c")).select(key, "c.*")


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row) after a set of changes, the last of each key."""
    last = net(changes, key)
    kept = snapshot.select(key, "row").join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("change <> 'remove'").select(key, "row"))


def overlay(base: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Read your own writes: staged rows (with `op` put or delete) over committed ones."""
    puts = staged.where("op = 'put'").drop("op")
    return base.join(staged.select(key), key, "left_anti").unionByName(puts)


def checksum(rows: DataFrame, key: Column, ts: Column, order_key: Column) -> DataFrame:
    """Drift checksum: XOR of the FNV-1a hash of each row's key, version and order key, as 8 hexadecimal digits.

    XOR is order-free and combines on the map side. A missing order key is the empty text.
    """
    text = F.concat(key.cast("string"), F.lit("\0"), ts.cast("string"), F.lit("\0"), F.coalesce(order_key.cast("string"), F.lit("")))
    folded = rows.agg(F.coalesce(F.bit_xor(fnv1a32(text)), F.lit(0)).alias("x"))
    return folded.select(F.lower(F.lpad(F.hex("x"), 8, "0")).alias("checksum"))


def version_poll(polls: DataFrame, table: str = "table_name", version: str = "version", poll: str = "poll") -> DataFrame:
    """Polls that invalidate: a table's version rose since its poll before; the first sight is only a baseline."""
    w = Window.partitionBy(table).orderBy(poll)
    seen = polls.withColumn("before", F.lag(version).over(w))
    return seen.where(F.col("before").isNotNull() & (F.col(version) > F.col("before"))).drop("before")


def density_gaps(incoming: DataFrame, heads: DataFrame) -> DataFrame:
    """Incoming revisions whose `prev_ts` is not what the replica holds: a gap or a repeat."""
    w = Window.partitionBy("doc_id").orderBy("ts")
    seen = incoming.withColumn("_lag", F.lag("ts").over(w)).join(heads.select("doc_id", F.col("ts").alias("_head")), "doc_id", "left")
    return seen.where(~F.col("prev_ts").eqNullSafe(F.coalesce("_lag", "_head"))).drop("_lag", "_head")


def fingerprints(results: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """An order-free hash of each group's rows, to tell unchanged results without sending them."""
    return results.groupBy(group).agg(F.bit_xor(F.xxhash64(*columns)).alias("fingerprint"), F.count("*").alias("n"))


def optimistic(base: DataFrame, pending: DataFrame, observed_ts: int, key: str = "key") -> DataFrame:
    """A client's view: pending layers, those not yet confirmed at `observed_ts`, replayed over the server's rows.

    `pending` has columns seq, commit_ts (null or 0 until known), key, value (null removes).
    """
    live = pending.where(~((F.col("commit_ts") > 0) & (F.col("commit_ts") <= observed_ts)) | F.col("commit_ts").isNull())
    top = live.groupBy(key).agg(F.max_by(F.struct("value"), "seq").alias("t"))
    kept = base.select(key, "value").join(top.select(key), key, "left_anti")
    return kept.unionByName(top.select(key, F.col("t.value").alias("value")).where(F.col("value").isNotNull()))
