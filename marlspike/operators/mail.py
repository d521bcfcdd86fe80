"""Messages, inboxes and digests: transitions of whole tables, and the queries that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlspike.operators.jobs import backoff

BATCH = 64


def peek_queued(messages: DataFrame, now: float, most: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(messages to send now, earliest time of those put off) out of the first `most` queued ones by creation."""
    first = messages.where("status = 'queued'").orderBy("created_at", "message_id").limit(most)
    later = F.col("next_attempt_at").isNotNull() & (F.col("next_attempt_at") > now)
    return first.where(~later), first.agg(F.min(F.when(later, F.col("next_attempt_at"))).alias("earliest"))


def claim_messages(messages: DataFrame, wanted: DataFrame, now: float) -> DataFrame:
    """The table after claims: queued messages of `wanted` (message_id) are being sent, under a lease from now."""
    hit = messages.join(wanted.select("message_id").distinct().withColumn("_w", F.lit(True)), "message_id", "left")
    mine = F.coalesce("_w", F.lit(False)) & (F.col("status") == "queued")
    return hit.select(
        *[c for c in messages.columns if c not in ("status", "claimed_at")],
        F.when(mine, "sending").otherwise(F.col("status")).alias("status"),
        F.when(mine, F.lit(float(now))).otherwise(F.col("claimed_at")).alias("claimed_at"),
    )


def _retried(messages: DataFrame, hit: Column, sent: Column, again: Column, now: float, wait: Column) -> DataFrame:
    return messages.select(
        *[c for c in messages.columns if c not in ("status", "attempts", "next_attempt_at", "claimed_at", "payload", "_ok", "_retryable")],
        F.when(hit & sent, "sent").when(hit & again, "queued").when(hit, "failed").otherwise(F.col("status")).alias("status"),
        F.when(hit & ~sent, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit & ~sent & again, F.lit(float(now)) + wait).when(~hit, F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(~hit, F.col("claimed_at")).alias("claimed_at"),
        F.when(~hit | (~sent & again), F.col("payload")).alias("payload"),
    )


def mark_results(messages: DataFrame, results: DataFrame, now: float, most: int = 5, initial: float = 250, base: float = 2, random: float = 1.0) -> DataFrame:
    """The table after attempts (message_id, ok, retryable): sent, queued for a later attempt, or failed for good.

    Only messages that are being sent change. The payload goes with the last attempt; a null `retryable` is true.
    """
    r = results.select("message_id", F.col("ok").alias("_ok"), F.coalesce("retryable", F.lit(True)).alias("_retryable")).dropDuplicates(["message_id"])
    met = messages.join(r, "message_id", "left")
    hit = F.col("_ok").isNotNull() & (F.col("status") == "sending")
    again = F.col("_retryable") & (F.col("attempts") + 1 < most)
    return _retried(met, hit, F.coalesce("_ok", F.lit(False)), F.coalesce(again, F.lit(False)), now, backoff(F.col("attempts") + 1, initial, base, F.lit(random))).select(*messages.columns)


def reclaim_stuck(messages: DataFrame, now: float, lease: float = 60_000, most: int = 5, initial: float = 250, base: float = 2, random: float = 1.0, batch: int = BATCH) -> DataFrame:
    """The table after a sweep of the first `batch` messages being sent: those past their lease count an attempt."""
    first = messages.where("status = 'sending'").orderBy("created_at", "message_id").limit(batch)
    stuck = first.where(F.col("claimed_at").isNotNull() & (F.lit(float(now)) - F.col("claimed_at") >= lease)).select("message_id", F.lit(True).alias("_ok"))
    met = messages.join(stuck, "message_id", "left")
    hit, never = F.coalesce("_ok", F.lit(False)), F.lit(False)
    again = F.col("attempts") + 1 < most
    return _retried(met, hit, never, again, now, backoff(F.col("attempts") + 1, initial, base, F.lit(random))).select(*messages.columns)


INBOX = ["notification_id", "title", "body", "data", "read", "read_at", "created_at", "message_id"]


def inbox(notifications: DataFrame, user_id, limit: int = 50) -> DataFrame:
    """A user's newest notifications, in the fields that a client sees."""
    own = notifications.where(F.col("user_id") == user_id)
    return own.orderBy(F.col("created_at").desc(), F.col("notification_id").desc()).limit(limit).select(*[c for c in INBOX if c in notifications.columns])


def preferences_of(preferences: DataFrame, user_id) -> DataFrame:
    return preferences.where(F.col("user_id") == user_id).select("category", "channel", "enabled")


def digest_groups(items: DataFrame, windows: DataFrame, now: float, batch: int = 200) -> DataFrame:
    """(recipient, category, oldest) that are due among the first `batch` unflushed items.

    `windows` has (category, window); items of a category without one wait for ever.
    """
    first = items.where(F.col("flushed_at").isNull()).orderBy("created_at", "item_id").limit(batch)
    groups = first.groupBy("recipient", "category").agg(F.min("created_at").alias("oldest"))
    return groups.join(windows, "category").where(F.lit(now) - F.col("oldest") >= F.col("window")).select("recipient", "category", "oldest")


def flush(items: DataFrame, due: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(the items with all of the due groups' marked, a row for each digest: its items in order and its key)."""
    open_ = items.where(F.col("flushed_at").isNull()).join(due.select("recipient", "category"), ["recipient", "category"], "left_semi")
    sent = open_.groupBy("recipient", "category").agg(F.min("created_at").alias("oldest"), F.array_sort(F.collect_list(F.struct("created_at", "item_id"))).alias("items"))
    sent = sent.withColumn("idempotency_key", F.concat_ws(":", F.lit("digest"), "recipient", "category", "oldest"))
    marked = items.join(due.select("recipient", "category", F.lit(True).alias("_due")), ["recipient", "category"], "left")
    at = F.when(F.col("flushed_at").isNull() & F.col("_due"), F.lit(now)).otherwise(F.col("flushed_at"))
    return marked.withColumn("flushed_at", at).select(*items.columns), sent


def prune_receipts(receipts: DataFrame, floors: DataFrame, acked: DataFrame, before: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(receipts left, floors): those up to a client's acknowledged sequence go, and those made before a time.

    A floor rises to the highest of what went and what was acknowledged, and never falls.
    """
    keys = ["identity", "client_id"]
    met = receipts.join(acked.select(*keys, F.col("acked_through").alias("_a")), keys, "left")
    gone = F.coalesce(F.col("seq") <= F.col("_a"), F.lit(False)) | (F.lit(False) if before is None else F.coalesce(F.col("created_at") < before, F.lit(False)))
    tops = met.where(gone).groupBy(*keys).agg(F.max("seq").alias("_top"))
    raised = floors.join(tops, keys, "full_outer").join(acked.select(*keys, "acked_through"), keys, "full_outer")
    return met.where(~gone).select(*receipts.columns), raised.select(*keys, F.greatest("floor", "_top", "acked_through").alias("floor"))


def sessions_of(sessions: DataFrame, user_id, now: float) -> DataFrame:
    """A user's sessions that have not run out."""
    return sessions.where((F.col("user_id") == user_id) & (F.col("expires_at") > now))


def user_of(sessions: DataFrame, tokens: DataFrame, now: float) -> DataFrame:
    """(token, user_id) of tokens with a session that has not run out; null for the others."""
    live = sessions.where(F.col("expires_at") > now).select("token", "user_id")
    return tokens.join(live, "token", "left").select("token", "user_id")


def normalized_email(address: Column) -> Column:
    """The form of an address by which accounts are looked up."""
    return F.lower(F.trim(address))


def rendered(template: Column, data: dict[str, Column]) -> Column:
    """A template with each `{{name}}` replaced; a null value is the empty text."""
    for name, value in data.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
