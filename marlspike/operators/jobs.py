"""Set forms of the scheduler, triggers, workflows, notifications, receipts and authorization.

What a server does row by row in a loop is here one transformation of a whole table: who is due, what a batch of
transitions leaves, which rows a sweep removes.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marlspike.session import discard, materialize

#: Delivery statuses by rank; a lower or equal one never replaces a higher.
STATUS_RANK = {"dropped": 1, "bounced": 2, "complained": 2, "failed_permanent": 2, "delivered": 3, "opened": 4, "clicked": 5}


def rank_of(column: str, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(column))


# Due work


def due(jobs: DataFrame, now: float, most: int = 64, state: str = "pending") -> DataFrame:
    """The first due jobs by time, then identifier."""
    return jobs.where((F.col("state") == state) & (F.col("next_ts") <= now)).orderBy("next_ts", "job_id").limit(most)


def next_due(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.where(F.col("state") == "pending").agg(F.min(F.when(F.col("next_ts") > now, F.col("next_ts"))).alias("next_ts"))


def claim(jobs: DataFrame, now: float, lease: float = 30_000, most: int = 64) -> DataFrame:
    """The table after a claim: the due jobs in progress, under a lease."""
    taken = due(jobs, now, most).select("job_id", F.lit(True).alias("_taken"))
    mine = F.coalesce("_taken", F.lit(False))
    out = jobs.join(taken, "job_id", "left").withColumn("state", F.when(mine, "inProgress").otherwise(F.col("state")))
    return out.withColumn("lease_expires", F.when(mine, F.lit(now + lease)).otherwise(F.col("lease_expires"))).drop("_taken")


def backoff(attempts: Column, initial: float, base: float, random: Column) -> Column:
    """Milliseconds to wait after that many attempts, the failed one included; rounded half up."""
    return F.floor(initial * F.pow(F.lit(base), attempts + 1) * (0.5 + 0.5 * random) + 0.5).cast("long")


def fail(jobs: DataFrame, failed: DataFrame, now: float, initial: float = 250, base: float = 2, random: Column | None = None) -> DataFrame:
    """The table after failures: another attempt later, or failed for good at the limit."""
    f = failed.select("job_id", F.lit(True).alias("_f"))
    hit = F.coalesce("_f", F.lit(False))
    last = F.col("attempts") + 1 >= F.col("max_failures")
    out = jobs.join(f, "job_id", "left")
    return out.select(
        *[c for c in jobs.columns if c not in ("state", "attempts", "next_ts", "lease_expires")],
        F.when(hit & last, "failed").when(hit, "pending").otherwise(F.col("state")).alias("state"),
        F.when(hit & ~last, F.lit(now) + backoff(F.col("attempts") + 1, initial, base, F.lit(1.0) if random is None else random)).otherwise(F.col("next_ts")).alias("next_ts"),
        F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(hit, F.lit(None)).otherwise(F.col("lease_expires")).alias("lease_expires"),
    )


def expired_leases(jobs: DataFrame, now: float, most: int = 64) -> DataFrame:
    """The first jobs by due time, then identifier, whose lease has run out."""
    return jobs.where((F.col("state") == "inProgress") & F.coalesce(F.col("lease_expires") < now, F.lit(False))).orderBy("next_ts", "job_id").limit(most)


def reclaim(jobs: DataFrame, now: float, most: int = 64) -> DataFrame:
    """The table after a sweep of expired leases: a mutation with attempts left is pending again at once, all else failed.

    An action is never run again, since its effects may have happened. `jobs` has columns kind and completed_ts besides.
    """
    hit = F.coalesce("_hit", F.lit(False))
    again = (F.col("kind") == "mutation") & (F.col("attempts") + 1 < F.col("max_failures"))
    out = jobs.join(expired_leases(jobs, now, most).select("job_id", F.lit(True).alias("_hit")), "job_id", "left")
    return out.select(
        *[c for c in jobs.columns if c not in ("state", "attempts", "next_ts", "lease_expires", "completed_ts")],
        F.when(hit & again, "pending").when(hit, "failed").otherwise(F.col("state")).alias("state"),
        F.when(hit & again, F.lit(now)).otherwise(F.col("next_ts")).alias("next_ts"),
        F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~hit, F.col("lease_expires")).alias("lease_expires"),
        F.when(hit & ~again, F.lit(now)).otherwise(F.col("completed_ts")).alias("completed_ts"),
    )


def complete(jobs: DataFrame, done: DataFrame, now: float) -> DataFrame:
    """The table after successes: the jobs of `done` (job_id) that are in progress succeed; others stay as they are."""
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("state") == "inProgress")
    out = jobs.join(done.select("job_id", F.lit(True).alias("_hit")).distinct(), "job_id", "left")
    return out.select(
        *[c for c in jobs.columns if c not in ("state", "lease_expires", "completed_ts")],
        F.when(hit, "success").otherwise(F.col("state")).alias("state"),
        F.when(~hit, F.col("lease_expires")).alias("lease_expires"),
        F.when(hit, F.lit(now)).otherwise(F.col("completed_ts")).alias("completed_ts"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: idempotent enqueueing and receipts. A null key is never a duplicate."""
    known = rows.where(F.col(keys[-1]).isNotNull())
    first = known.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(rows.where(F.col(keys[-1]).isNull()))


def enqueue_time(run_at: Column, run_after: Column, now: float) -> Column:
    return F.coalesce(run_at, F.lit(now) + F.greatest(F.lit(0.0), run_after), F.lit(now))


def descendants(spark: SparkSession, jobs: DataFrame, root) -> DataFrame:
    """All jobs under a root by their parents, the root included; a written table.

    A job has one parent, so pointers double: after k rounds each job knows whether the root is among its next 2**k
    ancestors. Rounds grow with the logarithm of the depth, and each has one row per job. A cycle of parents ends too.
    """
    own = jobs.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max("parent_id").alias("up"))
    kind = jobs.schema["job_id"].dataType
    top = spark.range(1).select(F.lit(root).cast(kind).alias("job_id"), F.lit(None).cast(kind).alias("up"))
    nodes = own.where(F.col("job_id") != F.lit(root)).union(top).withColumn("hit", F.col("job_id") == F.lit(root))
    nodes = materialize(nodes.withColumn("up", F.col("up").cast(kind)), "nodes")
    rounds = nodes.count().bit_length() + 1
    for _ in range(rounds):
        above = nodes.select(F.col("job_id").alias("_id"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        met = nodes.join(above, F.col("up") == F.col("_id"), "left")
        further = materialize(met.select("job_id", F.when(~F.col("hit"), F.col("_up")).alias("up"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")), "nodes")
        discard(nodes)
        nodes = further
        if nodes.where(F.col("up").isNotNull()).isEmpty():
            break
    out = materialize(nodes.where("hit").select("job_id"), "descendants")
    discard(nodes)
    return out


def cancel(spark: SparkSession, jobs: DataFrame, root) -> DataFrame:
    """The table after a cancel: pending jobs under the root, itself included, are canceled; the walk goes through any state."""
    hit = descendants(spark, jobs, root).withColumn("_hit", F.lit(True))
    out = jobs.join(hit, "job_id", "left")
    return out.withColumn("state", F.when(F.col("_hit") & (F.col("state") == "pending"), "canceled").otherwise(F.col("state"))).drop("_hit")


def closure(spark: SparkSession, edges: DataFrame, roots: list) -> DataFrame:
    """Nodes that the roots reach, at any depth, breadth first; a written table.

    Each round looks only at nodes not seen before, so cycles end. Levels are merged into one table whenever there are
    eight of them, so a round reads few tables however many levels came before.
    """
    edges = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    front = materialize(spark.createDataFrame([(r,) for r in roots], f"node {kind}").distinct(), "front")
    levels = [front]
    while True:
        seen = reduce(DataFrame.union, levels)
        step = edges.join(front, edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen, "node", "left_anti"), "front")
        last = front.isEmpty()
        if last or len(levels) == 8:
            merged = materialize(seen, "seen")
            discard(*levels)
            levels = [merged]
        if last:
            discard(front)
            return levels[0]
        levels.append(front)


# Calendars


def interval_runs(anchor: float, period: float, now: float, mode: str, cap: int = 1000) -> list[float]:
    """Missed runs of an interval schedule up to now: none but a single due one (skip), the last (fireOnce), or all, oldest first."""
    n = int((now - anchor) // period)
    if n <= 0:
        return []
    if n == 1:
        return [anchor + period]
    return {"skip": [], "fireOnce": [anchor + n * period], "fireAll": [anchor + (i + 1) * period for i in range(min(n, cap))]}[mode]


def cron_field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (map(int, span.split("-")) if "-" in span else (int(span), int(span) if not step else high))
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def cron_next(expr: str, after_ms: float, tz: str = "UTC", back: bool = False) -> float:
    """The first run strictly after a time, or with `back` the last one at or before it; five fields, local time of `tz`."""
    minute, hour, day, month, weekday = expr.split()
    zone = ZoneInfo(tz)
    minutes, hours, days, months = cron_field(minute, 0, 59), cron_field(hour, 0, 23), cron_field(day, 1, 31), cron_field(month, 1, 12)
    weekdays = {d % 7 for d in cron_field(weekday, 0, 7)}

    def fits(d: dt.date) -> bool:
        by_day, by_week = d.day in days, (d.weekday() + 1) % 7 in weekdays
        either = by_day or by_week if day != "*" and weekday != "*" else by_day and by_week
        return d.month in months and either

    start = dt.datetime.fromtimestamp(after_ms / 1000, zone)
    d, step = start.date(), dt.timedelta(days=-1 if back else 1)
    for _ in range(366 * 8):
        if fits(d):
            for h in sorted(hours, reverse=back):
                for m in sorted(minutes, reverse=back):
                    t = dt.datetime(d.year, d.month, d.day, h, m, tzinfo=zone)
                    ms = t.timestamp() * 1000
                    if dt.datetime.fromtimestamp(ms / 1000, zone).hour == h and (ms <= after_ms if back else ms > after_ms):
                        return ms
        d += step
    raise ValueError("the expression never comes due")


def every(kind: str, minute: int = 0, hour: int = 0, weekday: int = 0, day: int = 1) -> str:
    """Cron expressions of the named schedules, in UTC."""
    return {"hourly": f"{minute} * * * *", "daily": f"{minute} {hour} * * *", "weekly": f"{minute} {hour} * * {weekday}", "monthly": f"{minute} {hour} {day} * *"}[kind]


# Workflows


def dispatch(steps: DataFrame, most: int = 16) -> DataFrame:
    """The new steps that each workflow may start now, in step order."""
    w = Window.partitionBy("workflow_id").orderBy("step_number")
    return steps.where(F.col("state") == "new").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def compensation(steps: DataFrame) -> DataFrame:
    """Steps to undo, latest first: successful, undoable, not yet undone."""
    ready = steps.where((F.col("state") == "success") & F.col("compensable") & ~F.coalesce("compensated", F.lit(False)))
    return ready.withColumn("undo_order", F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.col("step_number").desc())))


# Notifications


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("n_unread"))


def digests_due(items: DataFrame, now: float, window: float) -> DataFrame:
    """Groups of unflushed items whose oldest is a window old, with the items in order."""
    open_ = items.where(F.col("flushed_at").isNull())
    groups = open_.groupBy("recipient", "category").agg(F.min("created_at").alias("oldest"), F.array_sort(F.collect_list(F.struct("created_at", "item_id"))).alias("items"))
    return groups.where(F.lit(now) - F.col("oldest") >= window)


def settle_status(events: DataFrame, ranks: dict[str, int] = STATUS_RANK) -> DataFrame:
    """Delivery status by highest rank, first of its rank; a complaint keeps its first time."""
    ranked = events.withColumn("_rank", rank_of("status", ranks))
    return ranked.groupBy("message_id").agg(F.max_by("status", F.struct("_rank", -F.col("ts"), -F.col("seq"))).alias("status"), F.min(F.when(F.col("status") == "complained", F.col("ts"))).alias("complained_at"))


def resolve_preferences(wanted: DataFrame, preferences: DataFrame) -> DataFrame:
    """Whether each (user, category, channel) may be sent: its own setting, else the category's, else yes; critical always."""
    own = preferences.where(F.col("channel").isNotNull()).select("user_id", "category", "channel", F.col("enabled").alias("_own"))
    wide = preferences.where(F.col("channel").isNull()).select("user_id", "category", F.col("enabled").alias("_wide"))
    out = wanted.join(own, ["user_id", "category", "channel"], "left").join(wide, ["user_id", "category"], "left")
    return out.withColumn("allowed", F.col("critical") | F.coalesce("_own", "_wide", F.lit(True))).drop("_own", "_wide")


def fan_out(subscribers: DataFrame, channels: list[str]) -> DataFrame:
    """A row for each subscriber and distinct channel, with its idempotency key."""
    out = subscribers.withColumn("channel", F.explode(F.array_distinct(F.array(*map(F.lit, channels)))))
    return out.withColumn("idempotency_key", F.concat(F.length("key").cast("string"), F.lit(":"), F.col("key"), F.lit(":"), F.col("user_id").cast("string")))


# Receipts


def classify_receipts(asks: DataFrame, receipts: DataFrame, floors: DataFrame) -> DataFrame:
    """applied or failed by the receipt, else stale at or under the client's floor, else unknown."""
    keys = ["identity", "client_id"]
    out = asks.join(receipts.select(*keys, "seq", "verdict"), [*keys, "seq"], "left").join(floors.select(*keys, "floor"), keys, "left")
    return out.select(*keys, "seq", F.coalesce("verdict", F.when(F.col("seq") <= F.col("floor"), "stale"), F.lit("unknown")).alias("status"))


def sweep_receipts(receipts: DataFrame, floors: DataFrame, now: float, ttl: float) -> tuple[DataFrame, DataFrame]:
    """(receipts left, floors raised to the highest sequence that went); floors never fall."""
    keys = ["identity", "client_id"]
    old = F.col("created_at") < F.lit(now - ttl)
    gone = receipts.where(old).groupBy(*keys).agg(F.max("seq").alias("_top"))
    raised = floors.join(gone, keys, "full_outer").select(*keys, F.greatest("floor", "_top").alias("floor"))
    return receipts.where(~old), raised


def drain(outbox: DataFrame, chunk: int = 50) -> DataFrame:
    """The entries that go out, with the request (`chunk`) that each goes in.

    They go in order up to the first transient failure; a terminal one does not stop the rest.
    """
    w = Window.partitionBy("client_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return outbox.withColumn("_stop", F.max(F.when(F.col("outcome") == "transient", 1).otherwise(0)).over(w)).where("_stop = 0").drop("_stop").withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("client_id").orderBy("seq")) - 1) / chunk))


# Authorization


def candidate_keys(permission: Column) -> Column:
    """The stored patterns that grant `resource:action`. The first colon parts the two; without one the action is empty."""
    colon = F.lit(":")
    r = F.substring_index(permission, ":", 1)
    a = F.substr(permission, F.length(r) + 2)
    return F.array_distinct(F.array(F.concat(r, colon, a), F.concat(r, colon, F.lit("*")), F.concat(F.lit("*"), colon, a), F.lit("*:*")))


def can(asks: DataFrame, grants: DataFrame) -> DataFrame:
    """Whether each (user_id, scope_type, scope_id, permission) is granted in its scope, or globally (empty type and id)."""
    a = asks.withColumn("pattern", F.explode(candidate_keys(F.col("permission"))))
    scopes = F.array(F.struct(F.col("scope_type").alias("st"), F.col("scope_id").alias("si")), F.struct(F.lit("").alias("st"), F.lit("").alias("si")))
    a = a.withColumn("_s", F.explode(scopes)).select("*", "_s.st", "_s.si").drop("_s")
    g = grants.select(F.col("user_id").alias("gu"), F.col("scope_type").alias("gt"), F.col("scope_id").alias("gi"), F.col("permission").alias("gp")).distinct()
    met = a.join(g, (a["user_id"] == g["gu"]) & (a["st"] == g["gt"]) & (a["si"] == g["gi"]) & (a["pattern"] == g["gp"]), "left")
    return met.groupBy(*asks.columns).agg(F.max(F.col("gp").isNotNull()).alias("granted"))


def held(tuples: DataFrame) -> DataFrame:
    """(subject, relation, object) that hold for direct subjects: their own tuples, and those of one userset they are in.

    A userset is a group and a relation to it: a tuple whose subject is `group` with subject_relation `r` holds for all
    that have relation `r` to the group. There is one such step and no more.
    """
    own = tuples.where(F.coalesce("subject_relation", F.lit("")) == "").select("subject", "relation", "object")
    sets = tuples.where(F.col("subject_relation") != "").select(F.col("subject").alias("_g"), F.col("subject_relation").alias("_r"), F.col("relation").alias("_rel"), F.col("object").alias("_obj"))
    through = sets.join(own, (own["object"] == sets["_g"]) & (own["relation"] == sets["_r"])).select("subject", F.col("_rel").alias("relation"), F.col("_obj").alias("object"))
    return own.union(through).distinct()


def has_relation(asks: DataFrame, tuples: DataFrame) -> DataFrame:
    """Whether each asked (subject, relation, object) holds."""
    holding = held(tuples).withColumn("holds", F.lit(True))
    return asks.join(holding, ["subject", "relation", "object"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def objects_with(tuples: DataFrame, relation: str) -> DataFrame:
    """(subject, object) pairs that the relation holds for."""
    return held(tuples).where(F.col("relation") == relation).select("subject", "object")


def scopes_with(grants: DataFrame, permission: str, scope_type: str | None = None) -> DataFrame:
    """(user_id, scope_id) where a stored pattern grants the permission."""
    met = grants.where(F.array_contains(candidate_keys(F.lit(permission)), F.col("permission")))
    met = met if scope_type is None else met.where(F.col("scope_type") == scope_type)
    return met.select("user_id", "scope_id").distinct()


def reconcile(have: DataFrame, want: DataFrame) -> DataFrame:
    """Rows to insert and to delete so that `have` becomes `want`."""
    have, want = have.distinct(), want.distinct()
    return want.join(have, have.columns, "left_anti").withColumn("action", F.lit("insert")).unionByName(have.join(want, have.columns, "left_anti").withColumn("action", F.lit("delete")))


# Storage and routes


def reclaimable(files: DataFrame, now: float) -> DataFrame:
    return files.where((F.col("status") == "pending") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now))


#: Routes that may be broadcast.
FEW_ROUTES = 100_000


def match_route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """The route of each request: an exact path, else the longest prefix, of the same method.

    A request looks up each of its own prefixes, so the join is on equality. It is said by hand which side is sent
    round, as Spark takes the size of the requests before they are exploded: the routes, or if these are many none.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    asked = requests.withColumn("_try", F.explode(prefixes))
    kinds = routes.select(F.col("method").alias("_m"), F.col("pattern"), F.col("kind"), F.col("route_id"))
    kinds = kinds.hint("broadcast" if kinds.limit(FEW_ROUTES + 1).count() <= FEW_ROUTES else "merge")
    met = asked.join(kinds, (asked["method"] == kinds["_m"]) & (asked["_try"] == kinds["pattern"]) & ((F.col("kind") == "prefix") | (F.col("_try") == F.col("path"))))
    rank = F.struct((F.col("kind") == "exact").cast("int"), F.length("pattern"))
    return met.groupBy(*requests.columns).agg(F.max_by("route_id", rank).alias("route_id"))
