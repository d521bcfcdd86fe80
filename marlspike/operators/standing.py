"""Standing queries by their kind: one document, an index range, or a page with fixed bounds; and what clients apply.

A diff is a row (key, change, row, ts): add, edit or remove. `order_key` sorts a rendered result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlspike.operators.incremental import membership_diff


def classify(reads: DataFrame) -> DataFrame:
    """How changes reach each standing query: `kind` is byid, range or page, or rerun.

    `reads` has for each run: n_reads, reader (get, collect, paginate), untouched (its result is returned as it is),
    has_policy, limited, scan_capped. Only a single such read can be followed change by change.
    """
    followed = (F.col("n_reads") == 1) & F.col("untouched") & ~F.col("has_policy")
    kind = F.when(followed & (F.col("reader") == "get"), "byid").when(followed & (F.col("reader") == "collect") & ~F.col("limited"), "range")
    return reads.withColumn("kind", kind.when(followed & (F.col("reader") == "paginate") & ~F.col("scan_capped"), "page").otherwise("rerun"))


def by_id_diff(feed: DataFrame, subscriptions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sub_id, key, change, ts, row) for subscriptions (sub_id, key) to single documents: each write is one change."""
    met = feed.join(subscriptions.select("sub_id", F.col(key).alias("_k")), F.col(key) == F.col("_k"))
    change = F.when(F.col("value").isNull(), "remove").when(F.col("old_value").isNull(), "add").otherwise("edit")
    return met.where(F.col("value").isNotNull() | F.col("old_value").isNotNull()).select("sub_id", key, change.alias("change"), "ts", F.col("value").alias("row"))


def within(order_key: Column, after=None, upto=None, descending: bool = False) -> Column:
    """Whether a page owns a key: past `after`, up to and with `upto`, in the index's order; null ends are open."""
    past = F.lit(True) if after is None else order_key < F.lit(after) if descending else order_key > F.lit(after)
    to = F.lit(True) if upto is None else order_key >= F.lit(upto) if descending else order_key <= F.lit(upto)
    return F.coalesce(past & to, F.lit(False))


def page_diff(feed: DataFrame, order_key, after=None, upto=None, admits=None, descending: bool = False) -> DataFrame:
    """Diffs of a page with fixed bounds: rows enter and leave it, and its cursor and bounds stay as they were.

    `order_key` and `admits` make columns from the name of a struct column.
    """
    inside = lambda c: within(order_key(c), after, upto, descending) & (F.lit(True) if admits is None else F.coalesce(admits(c), F.lit(False)))
    return membership_diff(feed, inside)


def owned(pages: DataFrame) -> DataFrame:
    """(page, after, upto): the interval of keys that each page of `page_bounds` owns; the first and the last are open."""
    before = pages.select((F.col("page") + 1).alias("page"), F.col("last").alias("after"))
    return pages.join(before, "page", "left").select("page", "after", F.when(F.col("next_first").isNotNull(), F.col("last")).alias("upto"))


def render(rows: DataFrame, order_key: str, descending: bool = False, page_size: int | None = None) -> DataFrame:
    """A result as a client shows it: by order key, ties by key."""
    c = F.col(order_key)
    out = rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col("key").desc() if descending else F.col("key"))
    return out if page_size is None else out.limit(page_size)


def bracketed(transitions: DataFrame) -> DataFrame:
    """Each session's transitions (session, seq, start_version, end_version) with `applies`.

    One applies if its start is the end of the one before it and all before it applied; else the session has to
    synchronise anew.
    """
    w = Window.partitionBy("session").orderBy("seq")
    fits = F.col("start_version") == F.coalesce(F.lag("end_version").over(w), F.lit(0))
    seen = transitions.withColumn("_bad", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
    return seen.withColumn("applies", F.max("_bad").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0).drop("_bad")


def resumable(entries: DataFrame, now: float, ttl: float = 60_000) -> DataFrame:
    """Resume entries (fingerprint, released_at) that are still held: in use (null), or released within the time to live."""
    return entries.where(F.col("released_at").isNull() | (F.col("released_at") + ttl > now))


def drifted(server: DataFrame, client: DataFrame) -> DataFrame:
    """Results (sub_id, checksum) whose checksums differ, or that one side lacks."""
    s, c = server.select("sub_id", F.col("checksum").alias("_s")), client.select("sub_id", F.col("checksum").alias("_c"))
    return s.join(c, "sub_id", "full_outer").where(~F.col("_s").eqNullSafe(F.col("_c"))).select("sub_id")


def silent(pings: DataFrame, now: float, period: float = 30_000, missed: int = 2) -> DataFrame:
    """Sessions (session, last_pong) that have missed so many heartbeats."""
    return pings.groupBy("session").agg(F.max("last_pong").alias("last_pong")).where(F.lit(now) - F.col("last_pong") > period * missed)


def fitting(frames: DataFrame, most: int = 200, most_bytes: int = 1 << 20) -> DataFrame:
    """The frames (session, seq, bytes, droppable) that a session's queue takes: droppable ones while both bounds hold."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = frames.withColumn("_n", F.count("*").over(w)).withColumn("_b", F.sum("bytes").over(w))
    return seen.where(~F.col("droppable") | ((F.col("_n") <= most) & (F.col("_b") <= most_bytes))).drop("_n", "_b")


def once(changes: DataFrame) -> DataFrame:
    """Changes of a feed that delivers at least once, each change identifier once."""
    return changes.dropDuplicates(["change_id"])


def live_stats(sessions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row: open sessions and their subscriptions."""
    return sessions.agg(F.count("*").alias("n_sessions")).crossJoin(subscriptions.agg(F.count("*").alias("n_subscriptions")))


def batch_stats(batches: DataFrame) -> DataFrame:
    """Group-commit statistics per shard over (shard, batch, size): most, last, all, and batches."""
    return batches.groupBy("shard").agg(F.max("size").alias("most"), F.max_by("size", "batch").alias("last"), F.sum("size").alias("total"), F.count("*").alias("n_batches"))


def prunable(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Recent commits (commit_ts) that no active snapshot (snapshot_ts) can conflict with any more; without one, all."""
    floor = snapshots.agg(F.min("snapshot_ts").alias("_floor"))
    return commits.crossJoin(F.broadcast(floor)).where(F.col("_floor").isNull() | (F.col("commit_ts") <= F.col("_floor"))).drop("_floor")
