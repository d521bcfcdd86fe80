"""More registered queries: streams, windows, workflows, notifications, authorization, shards and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marlspike.operators import incremental, jobs, ranges, windows
from marlspike.queries import CDC, SUBS, query, subscriptions, the_log
from marlspike.session import TABLES, scratch_path, ship, table
from marlspike.sources import log as doclog
from marlspike.streaming import feed

# Streams


def log_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return doclog.from_events(feed.table_stream(spark, f"{sf_dir}/events.parquet", schema))


@query(CDC)
def stream_changes(spark, sf_dir):
    """The change feed by Structured Streaming, written batch by batch and read back."""
    ship(spark)
    out = feed.change_feed(log_stream(spark, sf_dir))
    slim = out.select("ts", "doc_id", "prev_ts", "op", F.col("value.value").alias("new_value"), F.col("old_value.value").alias("old_value"), "change_id")
    path = scratch_path(spark, "changes")
    feed.drive(slim, feed.into(path), scratch_path(spark, "cursor")).awaitTermination()
    return feed.written(spark, path, slim.schema)


@query(f"select distinct o_orderkey as commit_ts, sub_id from ({SUBS}) join orders on o_custkey >= low and o_custkey < high")
def stream_affected(spark, sf_dir):
    """Subscriptions that each commit of a stream of writes touches."""
    orders = feed.table_stream(spark, f"{sf_dir}/orders.parquet", table(spark, sf_dir, "orders").schema)
    writes = orders.select(F.col("o_orderkey").alias("commit_ts"), F.lit("orders").alias("keyspace"), F.col("o_custkey").alias("key"))
    path, subs = scratch_path(spark, "affected"), subscriptions(spark, sf_dir)
    pick = lambda batch: ranges.affected(subs, batch).select("commit_ts", "sub_id")
    feed.drive(writes, feed.into(path, pick), scratch_path(spark, "cursor")).awaitTermination()
    return feed.written(spark, path, "commit_ts long, sub_id long")


# Windows, shards, limits


@query("""with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events),
  r as (select user_id, event_id, rn, event_id as start, 1 as place from e where rn = 1 union all
    select e.user_id, e.event_id, e.rn, case when e.event_id - r.start >= 500 then e.event_id else r.start end, case when e.event_id - r.start >= 500 then 1 else r.place + 1 end
    from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, start as window_start, place <= 2 as admitted from r""")
def rate_limit(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", "user_id")
    return windows.rate_limit(calls, ["user_id"], "event_id", 2, 500).select("event_id", "window_start", "admitted")


@query("select case when count(*) >= 4 then min(frontier) else 0 end as stable_ts from (select max(event_id) as frontier from events group by user_id % 4)")
def log_stable_prefix(spark, sf_dir):
    frontiers = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("shard")).agg(F.max("event_id").alias("frontier"))
    return doclog.stable_prefix(frontiers, 4)


@query("select event_id as ts, user_id as doc_id from events where event_id > 500 and event_id % 37 = 0")
def log_density_gaps(spark, sf_dir):
    """Revisions whose stated predecessor is not the replica's; every 37th is made wrong here."""
    log = the_log(spark, sf_dir)
    heads = doclog.latest(log, 500)
    stated = F.when(F.col("ts") % 37 == 0, -1).otherwise(F.col("prev_ts"))
    return incremental.density_gaps(doclog.chain(log).withColumn("prev_ts", stated).where("ts > 500"), heads).select("ts", "doc_id")


@query("select o_orderkey as doc_id, (select max(event_id) from events) + dense_rank() over (order by o_custkey) as ts from orders")
def log_commit_units(spark, sf_dir):
    units = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("value"))
    return doclog.commit(the_log(spark, sf_dir), units).select("doc_id", "ts")


@query("select event_id from (select * from events order by event_id desc limit 1000) where event_type = 'error' and event_id > 100 order by event_id desc limit 50")
def log_recent(spark, sf_dir):
    return doclog.recent(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", (F.col("event_type") == "error") & (F.col("event_id") > 100)).select("event_id")


@query(f"""with s as (select *, max(high) over (order by low, high rows between unbounded preceding and 1 preceding) as before from ({SUBS})),
  g as (select *, sum(case when before >= low then 0 else 1 end) over (order by low, high rows between unbounded preceding and current row) as run from s)
  select min(low) as low, max(high) as high from g group by run""")
def range_union(spark, sf_dir):
    """The read set of every subscription, merged into one keyspace."""
    return ranges.union_ranges(subscriptions(spark, sf_dir)).select("low", "high")


@query("""with s as (select c_nationkey, c_custkey as low, c_custkey + 1 + (c_custkey % 40) * (c_custkey % 7) as high from customer),
  b as (select *, max(high) over (partition by c_nationkey order by low, high rows between unbounded preceding and 1 preceding) as before from s),
  g as (select *, sum(case when before >= low then 0 else 1 end) over (partition by c_nationkey order by low, high rows between unbounded preceding and current row) as run from b)
  select 'nation:' || c_nationkey as keyspace, min(low) as low, max(high) as high from g group by c_nationkey, run""")
def range_union_spaces(spark, sf_dir):
    """The read set of every subscription, merged within the customer's nation as keyspace."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sub_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("keyspace"))
    return ranges.union_ranges(subscriptions(spark, sf_dir).drop("keyspace").join(nation, "sub_id"))


@query("select user_id as txn_id, count(*) filter (event_type <> 'purchase') as n_reads, count(*) filter (event_type = 'purchase') as n_writes from events group by 1 having n_reads > 50 or n_writes > 50")
def transaction_limits(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "write").otherwise("read")
    return ranges.over_limit(table(spark, sf_dir, "events").select(F.col("user_id").alias("txn_id"), kind.alias("kind")), 50)


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_docs from {t}" for t in TABLES))
def list_tables(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n_docs")).select(F.lit(t).alias("table_name"), "n_docs") for t in TABLES]
    return reduce(lambda a, b: a.union(b), counts)


# Workflows and clients


def the_steps(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "new").when(F.col("event_type") == "purchase", "success").otherwise("failed")
    flags = [(F.col("event_id") % 2 == 0).alias("compensable"), (F.col("event_id") % 6 == 0).alias("compensated")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("workflow_id"), F.col("event_id").alias("step_number"), state.alias("state"), *flags)


@query("select workflow_id, step_number from (select user_id as workflow_id, event_id as step_number, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'click') where n <= 16")
def workflow_dispatch(spark, sf_dir):
    return jobs.dispatch(the_steps(spark, sf_dir)).select("workflow_id", "step_number")


@query("""select user_id as workflow_id, event_id as step_number, row_number() over (partition by user_id order by event_id desc) as undo_order
  from events where event_type = 'purchase' and event_id % 2 = 0 and event_id % 6 <> 0""")
def workflow_compensation(spark, sf_dir):
    return jobs.compensation(the_steps(spark, sf_dir)).select("workflow_id", "step_number", F.col("undo_order").cast("long").alias("undo_order"))


@query("""with p as (select n_nationkey % 7 as key, arg_max(case when n_nationkey % 3 > 0 then n_name end, n_nationkey) filter (n_nationkey % 3 > 0) as put, max(n_nationkey) as top
    from nation where n_nationkey > 5 group by 1)
  select key, put as value from p where top % 3 > 0 union all select r_regionkey, r_name from region where r_regionkey not in (select key from p)""")
def client_view(spark, sf_dir):
    """Unconfirmed layers over the server's rows; those confirmed at or before the observed commit are gone."""
    base = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    n = F.col("n_nationkey")
    pending = table(spark, sf_dir, "nation").select(n.alias("seq"), F.when(n <= 5, n + 1).cast("long").alias("commit_ts"), (n % 7).alias("key"), F.when(n % 3 > 0, F.col("n_name")).alias("value"))
    return incremental.optimistic(base, pending, 6)


@query("select event_id from events where event_type = 'view' and value <= 50")
def storage_reclaimable(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("ready").alias("status"), F.col("value").alias("expires_at"))
    return jobs.reclaimable(files, 50.0).select("event_id")


@query("select p_partkey, case when p_size = 7 then 1 when p_size < 40 then 2 else 3 end as route_id from part")
def route_match(spark, sf_dir):
    path = F.concat(F.when(F.col("p_size") < 40, "/parts/").otherwise("/other/"), F.col("p_size").cast("string"))
    asked = table(spark, sf_dir, "part").select("p_partkey", F.lit("GET").alias("method"), path.alias("path"))
    routes = spark.createDataFrame([("GET", "/parts/7", "exact", 1), ("GET", "/parts/", "prefix", 2), ("GET", "/", "prefix", 3), ("POST", "/parts/", "prefix", 4)], "method string, pattern string, kind string, route_id int")
    return jobs.match_route(asked, routes).select("p_partkey", "route_id")


# Notifications


@query("""select c_custkey as user_id, c_custkey % 5 = 0 or case when c_custkey % 2 = 0 then c_custkey % 4 = 0 when c_custkey % 3 = 0 then false else true end as allowed from customer""")
def notify_preferences(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.lit("news").alias("category"))
    own = c.where("user_id % 2 = 0").withColumn("channel", F.lit("email")).withColumn("enabled", F.col("user_id") % 4 == 0)
    wide = c.where("user_id % 3 = 0").withColumn("channel", F.lit(None).cast("string")).withColumn("enabled", F.lit(False))
    wanted = c.withColumn("channel", F.lit("email")).withColumn("critical", F.col("user_id") % 5 == 0)
    return jobs.resolve_preferences(wanted, own.unionByName(wide)).select("user_id", "allowed")


@query("""select channel, count(*) filter (c_acctbal > 0) as sent, count(*) filter (not c_acctbal > 0) as suppressed, min('4:news:' || c_custkey) as first_key
  from customer, (values ('email'), ('push')) v(channel) group by 1""")
def notify_fan_out(spark, sf_dir):
    """Totals of a broadcast to every subscriber on each distinct channel."""
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("news").alias("key"), (F.col("c_acctbal") > 0).alias("ok"))
    out = jobs.fan_out(subs, ["email", "push", "email"])
    return out.groupBy("channel").agg(F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("suppressed"), F.min("idempotency_key").alias("first_key"))


# Authorization


def the_tuples(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    members = n.select(name("user", "n_nationkey").alias("subject"), F.lit("").alias("subject_relation"), F.when(F.col("n_nationkey") % 4 == 0, "owner").otherwise("member").alias("relation"), name("group", "n_regionkey").alias("object"))
    sets = r.select(name("group", "r_regionkey").alias("subject"), F.lit("member").alias("subject_relation"), F.lit("viewer").alias("relation"), F.concat(F.lit("doc:"), (F.col("r_regionkey") % 3).cast("string")).alias("object"))
    owned = sets.withColumn("subject_relation", F.lit("owner")).withColumn("relation", F.lit("editor"))
    return members.union(sets).union(owned)


@query("select 'user:' || n_nationkey as subject, n_regionkey % 3 = n_nationkey % 3 and n_nationkey % 4 <> 0 as holds from nation")
def authz_has_relation(spark, sf_dir):
    k = F.col("n_nationkey")
    asks = table(spark, sf_dir, "nation").select(F.concat(F.lit("user:"), k.cast("string")).alias("subject"), F.lit("viewer").alias("relation"), F.concat(F.lit("doc:"), (k % 3).cast("string")).alias("object"))
    return jobs.has_relation(asks, the_tuples(spark, sf_dir)).select("subject", "holds")


@query("select 'user:' || n_nationkey as subject, 'doc:' || (n_regionkey % 3) as object from nation where n_nationkey % 4 = 0")
def authz_objects_with(spark, sf_dir):
    return jobs.objects_with(the_tuples(spark, sf_dir), "editor")


@query("select c_custkey as user_id, c_nationkey as scope_id from customer where c_custkey % 3 <> 2")
def authz_scopes_with(spark, sf_dir):
    k = F.col("c_custkey")
    permission = F.when(k % 3 == 0, "orders:*").when(k % 3 == 1, "*:read").otherwise("orders:write")
    grants = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.lit("nation").alias("scope_type"), F.col("c_nationkey").alias("scope_id"), permission.alias("permission"))
    return jobs.scopes_with(grants, "orders:read", "nation")


@query("with recursive r as (select 24 as node union select n_nationkey // 2 from nation join r on n_nationkey = node) select node from r")
def authz_roles(spark, sf_dir):
    """Roles that a role inherits, with itself; role 0 inherits itself, a cycle."""
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(k.alias("src"), F.floor(k / 2).cast("int").alias("dst"))
    return jobs.closure(spark, edges, [24])
