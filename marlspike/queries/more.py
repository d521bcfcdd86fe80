"""More registered queries: writes, global tables, segments, standing queries, messages, roles and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspike.operators import incremental, mail, ranges, roles, standing, windows, workflow
from marlspike.operators import jobs as scheduler
from marlspike.plans.query import over
from marlspike.queries import CDC, JOBS, LATEST, orders_query, query, the_jobs, the_log
from marlspike.session import scratch_path, table
from marlspike.sources import documents, segments, tables
from marlspike.sources import log as doclog

# Writes


def order_log(spark, sf_dir):
    """Two in three orders as live documents of a log; every seventh of all is a tombstone."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0")
    value = F.struct(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.lit(1).cast("long").alias("created"))
    return o.select(F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("ts"), F.when(F.col("o_orderkey") % 7 > 0, value).alias("value"))


def order_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    op = F.when(k % 4 == 0, "insert").when(k % 4 == 1, "replace").when(k % 4 == 2, "delete").otherwise("insert")
    value = F.struct((F.col("o_totalprice") - 1000).alias("price"), F.col("o_custkey").alias("customer"), F.lit(99).cast("long").alias("created"))
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("table_id"), k.alias("doc_id"), op.alias("op"), F.when(k % 4 != 2, value).alias("value"), F.lit(0).alias("seq"))


JUDGED = """with b as (select o_orderkey as k, o_totalprice as price, o_custkey as customer, o_orderkey % 3 > 0 and o_orderkey % 7 > 0 as there,
    case o_orderkey % 4 when 1 then 'replace' when 2 then 'delete' else 'insert' end as op from orders),
  j as (select *, case when op = 'insert' and there then 'exists' when op = 'replace' and not there then 'missing'
    when op <> 'delete' and not (price - 1000 > 20000) then 'invalid'
    when (there and customer % 5 = 0) or (op <> 'delete' and customer % 5 = 0) then 'forbidden' end as refused from b)"""


def judged_orders(spark, sf_dir):
    valid, policy = (lambda c: F.col(f"{c}.price") > 20000), (lambda c: F.col(f"{c}.customer") % 5 != 0)
    return documents.judge(order_log(spark, sf_dir), order_ops(spark, sf_dir), valid, policy)


@query(f"{JUDGED} select k as doc_id, op, refused from j")
def write_judged(spark, sf_dir):
    """Inserts, replacements and deletions of every order, with why they are refused."""
    return judged_orders(spark, sf_dir).select("doc_id", "op", "refused")


@query(f"""{JUDGED} select k as doc_id, case when op <> 'delete' then price - 1000 end as price, case op when 'insert' then 5 when 'replace' then 1 end as created
  from j where refused is null and (op <> 'delete' or there)""")
def write_revisions(spark, sf_dir):
    out = documents.revisions(judged_orders(spark, sf_dir), 5)
    return out.select("doc_id", "value.price", "value.created")


@query("""select o_orderkey as doc_id, case when o_orderkey % 2 = 0 and o_orderkey % 3 > 0 then 'exists'
    when exists (select 1 from orders x where x.o_orderkey % 3 > 0 and x.o_orderkey % 2 = 1 and x.o_custkey = o.o_custkey) then 'duplicate'
    when o_orderkey > (select min(y.o_orderkey) from orders y where y.o_orderkey % 2 = 0 and y.o_orderkey % 3 = 0 and y.o_custkey = o.o_custkey) then 'duplicate' end as refused
  from orders o where o_orderkey % 2 = 0""")
def write_unique(spark, sf_dir):
    """A unique field: one live order per customer may be added, and only where none stays."""
    o = table(spark, sf_dir, "orders")
    value = F.struct(F.col("o_custkey").alias("customer"))
    row = [F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("doc_id")]
    log = o.where("o_orderkey % 3 > 0 and o_orderkey % 2 = 1").select(*row, F.lit(1).cast("long").alias("ts"), value.alias("value"))
    held = o.where("o_orderkey % 3 > 0 and o_orderkey % 2 = 0").select(*row, F.lit(1).cast("long").alias("ts"), F.struct((-F.col("o_orderkey")).alias("customer")).alias("value"))
    ops = o.where("o_orderkey % 2 = 0").select(*row, F.lit("insert").alias("op"), value.alias("value"), F.lit(0).alias("seq"))
    return documents.judge(log.unionByName(held), ops, unique=["customer"]).select("doc_id", "refused")


@query("select event_id, '{\"type\":\"' || event_type || '\"' || case when value is null or event_id % 2 = 0 then '' else ',\"n\":' || event_id end || '}' as doc from events")
def document_compact(spark, sf_dir):
    n = F.when(F.col("value").isNotNull() & (F.col("event_id") % 2 > 0), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", documents.compacted(F.struct(F.col("event_type").alias("type"), n.alias("n"))).alias("doc"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'app' else '' end as namespace, c_mktsegment as name from customer")
def document_table_name(spark, sf_dir):
    full = F.concat(F.when(F.col("c_custkey") % 2 == 0, "app/").otherwise(""), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", documents.table_name(full).alias("t")).select("c_custkey", "t.namespace", F.col("t.table").alias("name"))


@query("select o_custkey as table_name, min(o_orderkey) as number from orders group by 1 having min(o_orderkey) % 3 = 0")
def dump_strangers(spark, sf_dir):
    """Table numbers of a dump that mean other tables in the target: every third is moved on by one here."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("table_name")).agg(F.min("o_orderkey").alias("number"))
    target = own.withColumn("number", F.col("number") + F.when(F.col("number") % 3 == 0, 10**9).otherwise(0))
    return documents.strangers(own, target)


# Global tables


@query("""with o as (select o_orderkey as k, o_orderstatus as status, o_totalprice as price from orders)
  select k, status, case when k % 5 = 1 then price + 1 else price end as price from o where k % 5 <> 0 union all select k + 1000000000, status, price from o where k % 5 = 2""")
def global_commit(spark, sf_dir):
    """A batch over a table: every fifth row goes, every fifth changes, and as many are new."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    seq = F.lit(0).alias("seq")
    ops = o.where("k % 5 = 0").select("*", F.lit("delete").alias("op"), seq).unionByName(o.where("k % 5 = 1").select("k", "status", (F.col("price") + 1).alias("price"), F.lit("replace").alias("op"), seq))
    fresh = (F.col("k") + 10**9).alias("k")
    ops = ops.unionByName(o.where("k % 5 = 2").select(fresh, "status", "price", F.lit("insert").alias("op"), seq)).unionByName(o.where("k % 5 = 3").select((F.col("k") + 2 * 10**9).alias("k"), "status", "price", F.lit("replace").alias("op"), seq))
    return tables.commit_batch(o, ops, "k")


@query("select event_type as table_name, 7 + count(distinct user_id) as version from events group by 1 union all select 'idle', 7")
def global_versions(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), F.col("user_id").alias("batch"))
    names = ops.select("table_name").distinct().union(spark.range(1).select(F.lit("idle"))).withColumn("version", F.lit(7))
    return tables.bump_versions(names, ops)


@query("select n_nationkey as k, n_name || case when n_nationkey % 4 = 1 then '!' else '' end as name from nation where n_regionkey = 2 and n_nationkey % 4 <> 0")
def global_overlay(spark, sf_dir):
    """Equality on a table under staged replacements and deletions."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    staged = n.where("k % 4 = 0").withColumn("op", F.lit("delete")).unionByName(n.where("k % 4 = 1").withColumn("name", F.concat("name", F.lit("!"))).withColumn("op", F.lit("replace")))
    return tables.overlay_query(n, staged, {"region": 2}, key="k").select("k", "name")


@query("select event_id, cast(user_id as varchar) as user_id, case when event_type = 'error' then 1 else 0 end as failed, '{\"k\":' || event_id || '}' as extra from events")
def global_row_codec(spark, sf_dir):
    """Documents to cells, after a way there and back."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), (F.col("event_type") == "error").alias("failed"), F.struct(F.col("event_id").alias("k")).alias("extra"))
    return tables.to_row(tables.from_row(tables.to_row(e), e.schema)).withColumn("event_id", F.col("event_id").cast("long"))


# Segments


def segment_store(spark, sf_dir):
    log, root = the_log(spark, sf_dir), scratch_path(spark, "store")
    top = log.agg(F.max("ts")).first()[0] or 0
    for upto in (top // 3, 2 * top // 3):
        segments.append(log, root, upto)
    old = segments.manifest(spark, root)
    segments.snapshot(spark, root, log.schema)
    segments.sweep(spark, root, old)
    segments.append(log, root, top)
    return log, root


@query(f"select user_id as doc_id, event_id as ts, event_type, value from ({LATEST.format(where='')}) where event_type <> 'error'")
def segment_restore(spark, sf_dir):
    """The newest documents from a snapshot and the segment after it."""
    log, root = segment_store(spark, sf_dir)
    return doclog.as_of(segments.read(spark, root, log.schema)).select("doc_id", "ts", "value.event_type", "value.value")


@query("select event_id as ts, user_id as doc_id from events")
def segment_tail(spark, sf_dir):
    """A replica that holds a prefix, after it has read what segments have beyond."""
    log, root = the_log(spark, sf_dir), scratch_path(spark, "store")
    top = log.agg(F.max("ts")).first()[0] or 0
    mark = -1
    replica = log.limit(0)
    for upto in (top // 2, top // 2, top):
        segments.append(log, root, upto)
        replica, mark = segments.tail(replica, root, log.schema, mark)
    return replica.select("ts", "doc_id")


@query("select event_id, user_id from events order by value, event_id limit 100")
def shards_merged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [e.where(F.coalesce(F.pmod("user_id", F.lit(4)), F.lit(0)) == i) for i in range(4)]
    return segments.merged(parts, ["value", "event_id"], 100).select("event_id", "user_id")


# Standing queries


@query("""select event_id, case when event_id % 3 <> 1 or event_type = 'error' or user_id % 7 = 0 then 'rerun' when event_type = 'click' then 'byid'
  when event_type = 'view' and event_id % 2 = 0 then 'range' when event_type = 'purchase' and event_id % 5 > 0 then 'page' else 'rerun' end as kind from events""")
def standing_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reader = F.when(F.col("event_type") == "click", "get").when(F.col("event_type") == "view", "collect").when(F.col("event_type") == "purchase", "paginate").otherwise("other")
    reads = e.select("event_id", F.when(F.col("event_id") % 3 == 1, 1).otherwise(2).alias("n_reads"), reader.alias("reader"), (F.col("event_type") != "error").alias("untouched"), (F.col("user_id") % 7 == 0).alias("has_policy"), (F.col("event_id") % 2 > 0).alias("limited"), (F.col("event_id") % 5 == 0).alias("scan_capped"))
    return standing.classify(reads).select("event_id", "kind")


@query(f"""select doc_id * 10 as sub_id, doc_id, ts, case when op = 'delete' then 'remove' when was is null or was = 'error' then 'add' else 'edit' end as change
  from (select c.*, lag(e.event_type) over (partition by user_id order by event_id) as was from ({CDC}) c join events e on e.event_id = c.ts)
  where op <> 'delete' or (was is not null and was <> 'error')""")
def standing_by_id(spark, sf_dir):
    """Changes of every document to a subscription of its own."""
    feed = doclog.changes(the_log(spark, sf_dir))
    subs = feed.select("doc_id").distinct().select((F.col("doc_id") * 10).alias("sub_id"), "doc_id")
    return standing.by_id_diff(feed, subs).select("sub_id", "doc_id", "ts", "change")


@query(f"select user_id as doc_id, value from ({LATEST.format(where='')}) where event_type <> 'error' and value > 20 and value <= 70 and event_type <> 'view'")
def standing_page(spark, sf_dir):
    """A page with fixed bounds, kept by the feed's diffs from its state as of a commit."""
    log, key, admits = the_log(spark, sf_dir), (lambda c: F.col(f"{c}.value")), (lambda c: F.col(f"{c}.event_type") != "view")
    base = doclog.as_of(log, 300).where(standing.within(key("value"), 20.0, 70.0) & admits("value")).select("doc_id", F.col("value").alias("row"))
    changes = standing.page_diff(doclog.changes(log).where("ts > 300"), key, 20.0, 70.0, admits)
    return incremental.apply_changes(base, changes).select("doc_id", "row.value")


@query("""with k as (select o_orderkey, (row_number() over (order by o_orderdate desc, o_orderkey desc) - 1) // 50 as page from orders where o_custkey between 100 and 300),
  p as (select page, arg_max(o_orderkey, -rn) as last from (select *, -row_number() over (partition by page order by o_orderdate desc, o_orderkey desc) as rn from (select k.page, o.* from k join orders o using (o_orderkey))) group by page)
  select p.page, q.last as after_key, case when p.page < (select max(page) from p) then p.last end as upto_key from p left join p q on q.page = p.page - 1""")
def page_intervals(spark, sf_dir):
    """The interval of keys that each page of a long result owns, newest first."""
    o = over(table(spark, sf_dir, "orders").where("o_custkey between 100 and 300"), ["o_orderdate"], ["o_orderkey"]).order("desc")
    return standing.owned(o.page_bounds(50)).select("page", F.col("after.o_orderkey").alias("after_key"), F.col("upto.o_orderkey").alias("upto_key"))


@query("""with t as (select user_id as session, event_id as seq, coalesce(lag(event_id) over w, 0) + case when event_id % 20 = 0 then 1 else 0 end as s, coalesce(lag(event_id) over w, 0) as p from events window w as (partition by user_id order by event_id))
  select session, seq, max(case when s <> p then 1 else 0 end) over (partition by session order by seq) = 0 as applies from t""")
def standing_bracket(spark, sf_dir):
    """Transitions of each session; every twentieth has a wrong start here."""
    t = doclog.chain(the_log(spark, sf_dir)).select(F.col("doc_id").alias("session"), F.col("ts").alias("seq"), (F.coalesce("prev_ts", F.lit(0)) + F.when(F.col("ts") % 20 == 0, 1).otherwise(0)).alias("start_version"), F.col("ts").alias("end_version"))
    return standing.bracketed(t).select("session", "seq", "applies")


@query("""select user_id as session, event_id as seq from (select *, count(*) over w as n, sum(length(props)) over w as b from events window w as (partition by user_id order by event_id)) where event_type = 'error' or (n <= 20 and b <= 200)""")
def session_backpressure(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.length("props").alias("bytes"), (F.col("event_type") != "error").alias("droppable"))
    return standing.fitting(frames, 20, 200).select("session", "seq")


@query("select user_id as session from events group by 1 having (select max(event_id) from events) - max(event_id) > 60")
def session_silent(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("event_id")).first()[0] or 0
    return standing.silent(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("last_pong")), top, 30).select("session")


@query("select event_type as shard, max(n) as most, arg_max(n, user_id) as last, cast(sum(n) as bigint) as total, count(*) as n_batches from (select event_type, user_id, count(*) as n from events group by 1, 2) group by 1")
def commit_stats(spark, sf_dir):
    batches = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("shard"), F.col("user_id").alias("batch")).agg(F.count("*").alias("size"))
    return standing.batch_stats(batches)


@query("select o_orderkey as commit_ts from orders where o_orderkey <= (select min(c_custkey) + 500 from customer)")
def commits_prunable(spark, sf_dir):
    snapshots = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 500).alias("snapshot_ts"))
    return standing.prunable(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_ts")), snapshots)


@query("select distinct commit_ts, sub_id from (select o_orderkey as commit_ts, c_custkey as sub_id from orders join customer on o_custkey = c_custkey where c_custkey % 3 > 0 union all select event_id, c_custkey from events, customer where event_type = 'error' and event_id % 50 = 0 and c_custkey % 3 = 0)")
def affected_globally(spark, sf_dir):
    """Subscriptions to single customers' orders, and to a global table whose version rises now and then."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    space = F.when(key % 3 > 0, "orders").otherwise("settings")
    subs = c.select(key.alias("sub_id"), space.alias("keyspace"), key.alias("low"), (key + 1).alias("high"))
    writes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_ts"), F.lit("orders").alias("keyspace"), F.col("o_custkey").alias("key"))
    polls = table(spark, sf_dir, "events").where("event_type = 'error' and event_id % 50 = 0").select(F.col("event_id").alias("commit_ts"), F.lit("settings").alias("keyspace"))
    return ranges.affected_at(subs, writes, polls)


@query("""with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events),
  r as (select user_id, event_id, rn, event_id as start, 1 as place from e where rn = 1 union all
    select e.user_id, e.event_id, e.rn, case when e.event_id - r.start >= 900 then e.event_id else r.start end, case when e.event_id - r.start >= 900 then 1 else r.place + 1 end
    from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, place > 3 as tripped from r""")
def circuit_breaker(spark, sf_dir):
    deliveries = table(spark, sf_dir, "events").select("event_id", "user_id")
    return windows.breaker(deliveries, ["user_id"], "event_id", 3, 900).select("event_id", "tripped")


@query("select distinct 't' || n_regionkey as table_name from nation")
def written_tables(spark, sf_dir):
    """Tables that a write set's keyspaces name."""
    n, name = table(spark, sf_dir, "nation"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string"))
    space = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("table:"), name)).otherwise(F.concat(F.lit("index:"), name, F.lit(":by_x")))
    return ranges.written_tables(n.select(space.alias("keyspace")))


# Jobs and messages


@query(f"""with d as (select job_id from ({JOBS}) where state = 'inProgress' and next_ts + 5 < 60 order by next_ts, job_id limit 64),
  j as (select *, job_id in (select job_id from d) as hit, job_id % 3 > 0 as is_mutation, job_id % 4 + 1 < 3 as more from ({JOBS}))
  select job_id, case when not hit then state when is_mutation and more then 'pending' else 'failed' end as state, case when hit then job_id % 4 + 1 else job_id % 4 end as attempts,
    case when hit and is_mutation and more then 60.0::double else next_ts end as next_ts, case when hit and not (is_mutation and more) then 60.0::double end as completed_ts from j""")
def jobs_reclaim(spark, sf_dir):
    """A sweep of expired leases: mutations with attempts left run again, actions never do."""
    j = the_jobs(spark, sf_dir).withColumn("kind", F.when(F.col("job_id") % 3 > 0, "mutation").otherwise("action")).withColumn("completed_ts", F.lit(None).cast("double"))
    return scheduler.reclaim(j, 60.0).select("job_id", "state", "attempts", "next_ts", "completed_ts")


@query(f"select job_id, case when state = 'inProgress' and job_id % 2 = 0 then 'success' else state end as state, case when state = 'inProgress' and job_id % 2 = 0 then 9.0::double end as completed_ts from ({JOBS})")
def jobs_complete(spark, sf_dir):
    j = the_jobs(spark, sf_dir).withColumn("completed_ts", F.lit(None).cast("double"))
    return scheduler.complete(j, j.where("job_id % 2 = 0").select("job_id"), 9.0).select("job_id", "state", "completed_ts")


@query(f"select job_id, case when job_id % 3 > 0 then job_id * 2 end as args from ({JOBS})")
def jobs_with_args(spark, sf_dir):
    j = the_jobs(spark, sf_dir)
    return workflow.with_args(j, j.where("job_id % 3 > 0").select("job_id", (F.col("job_id") * 2).alias("args"))).select("job_id", "args")


MESSAGES = "select event_id as message_id, case event_type when 'view' then 'queued' when 'click' then 'sending' else 'sent' end as status, event_id % 6 as attempts, event_id as created_at, case when event_id % 3 = 0 then value end as next_attempt_at, case when event_id % 5 > 0 then value end as claimed_at from events"


def the_messages(spark, sf_dir):
    m, e = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "sending").otherwise("sent")
    return m.select(e.alias("message_id"), status.alias("status"), (e % 6).alias("attempts"), e.alias("created_at"), F.when(e % 3 == 0, F.col("value")).alias("next_attempt_at"), F.when(e % 5 > 0, F.col("value")).alias("claimed_at"), F.col("event_type").alias("payload"))


@query(f"select message_id from (select * from ({MESSAGES}) where status = 'queued' order by created_at, message_id limit 64) where next_attempt_at is null or next_attempt_at <= 50")
def mail_queued(spark, sf_dir):
    return mail.peek_queued(the_messages(spark, sf_dir), 50.0)[0].select("message_id")


@query(f"select message_id, case when status = 'queued' and message_id % 2 = 0 then 'sending' else status end as status, case when status = 'queued' and message_id % 2 = 0 then 77.0 else claimed_at end as claimed_at from ({MESSAGES})")
def mail_claim(spark, sf_dir):
    m = the_messages(spark, sf_dir)
    return mail.claim_messages(m, m.where("message_id % 2 = 0"), 77.0).select("message_id", "status", "claimed_at")


RETRIED = """select message_id, case when not hit then status when ok then 'sent' when again then 'queued' else 'failed' end as status, case when hit and not ok then attempts + 1 else attempts end as attempts,
  case when hit and not ok and again then 100.0 + floor(250 * pow(2.0, attempts + 2) + 0.5) when not hit then next_attempt_at end as next_attempt_at, case when not hit then claimed_at end as claimed_at from m"""


@query(f"""with m as (select *, status = 'sending' and message_id % 2 = 0 as hit, message_id % 4 = 0 as ok, message_id % 10 > 0 and attempts + 1 < 5 as again from ({MESSAGES})) {RETRIED}""")
def mail_results(spark, sf_dir):
    m, k = the_messages(spark, sf_dir), F.col("message_id")
    results = m.where("message_id % 2 = 0").select("message_id", (k % 4 == 0).alias("ok"), F.when(k % 10 == 0, False).alias("retryable"))
    return mail.mark_results(m, results, 100.0).select("message_id", "status", "attempts", "next_attempt_at", "claimed_at")


@query(f"""with s as (select message_id from (select * from ({MESSAGES}) where status = 'sending' order by created_at, message_id limit 64) where claimed_at is not null and 100 - claimed_at >= 40),
  m as (select *, message_id in (select message_id from s) as hit, false as ok, attempts + 1 < 5 as again from ({MESSAGES})) {RETRIED}""")
def mail_reclaim(spark, sf_dir):
    return mail.reclaim_stuck(the_messages(spark, sf_dir), 100.0, 40.0).select("message_id", "status", "attempts", "next_attempt_at", "claimed_at")


@query("select event_id as notification_id, event_type as title, event_type = 'view' as read, event_id as created_at from events where user_id = 7 order by event_id desc limit 50")
def mail_inbox(spark, sf_dir):
    n = table(spark, sf_dir, "events").select(F.col("event_id").alias("notification_id"), "user_id", F.col("event_type").alias("title"), (F.col("event_type") == "view").alias("read"), F.col("event_id").alias("created_at"), "props")
    return mail.inbox(n, 7)


@query("""with w as (select * from (values ('click', 100), ('view', 5000)) v(category, win)), f as (select * from events where value < 60 order by event_id, event_id limit 200),
  g as (select user_id as recipient, event_type as category, min(event_id) as oldest from f group by 1, 2), d as (select g.* from g join w using (category) where 400 - oldest >= win)
  select user_id as recipient, event_type as category, min(event_id) as oldest, count(*) as n_items, 'digest:' || user_id || ':' || event_type || ':' || min(event_id) as idempotency_key
  from events where value < 60 and (user_id, event_type) in (select (recipient, category) from d) group by 1, 2""")
def mail_digests(spark, sf_dir):
    """Digests that are due by their category's window, with all their items and keys."""
    e = table(spark, sf_dir, "events")
    flushed = F.when(~F.coalesce(F.col("value") < 60, F.lit(False)), F.lit(1)).cast("long")
    items = e.select(F.col("user_id").alias("recipient"), F.col("event_type").alias("category"), F.col("event_id").alias("created_at"), F.col("event_id").alias("item_id"), flushed.alias("flushed_at"))
    due = mail.digest_groups(items, spark.createDataFrame([("click", 100), ("view", 5000)], "category string, window long"), 400)
    _, sent = mail.flush(items, due, 400)
    return sent.select("recipient", "category", "oldest", F.size("items").cast("long").alias("n_items"), "idempotency_key")


@query("""with r as (select user_id as client_id, event_id as seq, event_id <= user_id * 30 or event_id < 200 as gone from events),
  c as (select distinct user_id as client_id from events)
  select client_id, greatest(client_id * 10, case when client_id % 2 = 0 then client_id * 30 end, (select max(seq) from (select user_id, event_id as seq from events where (user_id % 2 = 0 and event_id <= user_id * 30) or event_id < 200) g where g.user_id = client_id)) as floor from c""")
def receipts_acked(spark, sf_dir):
    """Floors after acknowledged prefixes and old receipts went."""
    e = table(spark, sf_dir, "events").select(F.lit("u").alias("identity"), F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("created_at"))
    clients = e.select("identity", "client_id").distinct()
    acked = clients.where("client_id % 2 = 0").withColumn("acked_through", F.col("client_id") * 30)
    return mail.prune_receipts(e, clients.withColumn("floor", F.col("client_id") * 10), acked, 200)[1].select("client_id", "floor")


@query("select c_custkey as user_id, lower(trim(c_name)) as email, 'Dear ' || c_name || ', ' || c_mktsegment as body from customer")
def mail_rendered(spark, sf_dir):
    name = F.col("c_name")
    body = mail.rendered(F.lit("Dear {{name}}, {{what}}"), {"name": name, "what": F.col("c_mktsegment")})
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), mail.normalized_email(F.concat(F.lit(" "), name, F.lit(" "))).alias("email"), body.alias("body"))


@query("select o_custkey as token, case when max(o_orderkey) % 3 > 0 then o_custkey * 2 end as user_id from orders group by 1")
def session_users(spark, sf_dir):
    """Whose token it is; sessions that have run out are nobody's."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("token")).agg((F.max("o_orderkey") % 3).alias("expires_at")).withColumn("user_id", F.col("token") * 2)
    return mail.user_of(s, s.select("token"), 0)


# Roles and workflows


@query("""with recursive up as (select n_nationkey as role, n_nationkey as holder from nation union select up.role, n.n_nationkey // 3 from up join nation n on n.n_nationkey = up.holder)
  select distinct up.role, 'part' || n.n_regionkey || ':' || case when n.n_nationkey % 2 = 0 then 'read' else 'write' end as pattern from up join nation n on n.n_nationkey = up.holder""")
def role_patterns(spark, sf_dir):
    """Own and inherited patterns of every role; role 0 inherits itself."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    inherits = n.select(k.alias("role"), F.floor(k / 3).cast(n.schema["n_nationkey"].dataType).alias("parent"))
    grants = n.select(k.alias("role"), F.concat(F.lit("part"), F.col("n_regionkey").cast("string")).alias("resource"), F.when(k % 2 == 0, "read").otherwise("write").alias("action"))
    return roles.expand(spark, inherits, grants)


@query("""with want as (select distinct c_custkey as user_id, case when c_nationkey % 2 = 0 then 'a:read' else 'b:write' end as permission from customer union select c_custkey, 'a:list' from customer where c_nationkey % 2 = 0),
  have as (select c_custkey as user_id, case when c_custkey % 2 = 0 then 'a:read' else 'old:x' end as permission from customer)
  select 'insert' as action, * from (select * from want except select * from have) union all select 'delete', * from (select * from have except select * from want)""")
def role_repairs(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    patterns = spark.createDataFrame([("even", "a:read"), ("even", "a:list"), ("odd", "b:write")], "role string, pattern string")
    scope = [F.lit("").alias("scope_type"), F.lit("").alias("scope_id")]
    assigned = c.select(k.alias("user_id"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("role"), *scope)
    have = c.select(k.alias("user_id"), *scope, F.when(k % 2 == 0, "a:read").otherwise("old:x").alias("permission"))
    return roles.repairs(have, assigned, patterns).select("action", "user_id", "permission")


@query("""with r as (select user_id as w, event_id as n, event_type as t, row_number() over (partition by user_id order by event_id) - 1 as i from events),
  s as (select *, case when i >= 40 then 'new' when n % 97 = 0 then 'mismatch' when t = 'error' and n % 5 = 0 then 'failed' when n % 31 = 0 then 'pending' end as stop from r),
  f as (select w, min(i) filter (stop is not null) as at from s group by w)
  select f.w as workflow_id, case when f.at is null then 'completed' when s.stop in ('new', 'pending') then 'suspended' else s.stop end as outcome, f.at as at_step, case when s.stop = 'new' then s.t end as new_step
  from f left join s on s.w = f.w and s.i = f.at""")
def workflow_replay(spark, sf_dir):
    """Where every run stands when it is replayed against its journal of up to forty steps."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("workflow_id"), place.alias("step_number"), F.lit("mutation").alias("kind"), F.col("event_type").alias("name"), F.col("event_id").alias("args"))
    state = F.when((F.col("name") == "error") & (F.col("args") % 5 == 0), "failed").when(F.col("args") % 31 == 0, "pending").otherwise("success")
    journal = r.where("step_number < 40").select("workflow_id", "step_number", "kind", "name", F.when(F.col("args") % 97 == 0, -1).otherwise(F.col("args")).alias("args"), state.alias("state"), F.lit(None).cast("string").alias("error"))
    return workflow.replay(r, journal).select("workflow_id", "outcome", "at_step", "new_step")


@query("""with e as (select user_id as w, event_type as name, event_id as id, event_id % 2 = 0 as waiting from events), f as (select w, name, min(id) filter (waiting) as id from e group by 1, 2)
  select e.id as event_id, case when f.id is not null and e.w % 3 > 0 then 'received' when e.waiting then 'waiting' else 'received' end as state, case when f.id is not null and e.w % 3 > 0 then e.w * 10 end as payload
  from e left join f on f.w = e.w and f.name = e.name and f.id = e.id""")
def workflow_events(spark, sf_dir):
    """The first waiting event of each run and name takes what was sent to it."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("workflow_id"), F.col("event_type").alias("name"), "event_id", F.when(F.col("event_id") % 2 == 0, "waiting").otherwise("received").alias("state"), F.lit(None).cast("long").alias("payload"))
    steps = rows.select("workflow_id", F.col("event_id").alias("step_number"), F.lit("waitForEvent").alias("kind"), "name", F.lit("pending").alias("state"), F.lit(None).cast("long").alias("result"))
    sent = rows.where("workflow_id % 3 > 0").select("workflow_id", "name", (F.col("workflow_id") * 10).cast("long").alias("payload"), F.col("event_id").alias("seq"))
    return workflow.send_events(rows, steps, sent)[0].select("event_id", "state", "payload")


# Readers


@query("select o_orderkey from (select * from orders order by o_custkey, o_orderdate, o_orderkey limit 1000) where o_orderstatus = 'F' and o_totalprice > 50000 order by o_custkey, o_orderdate, o_orderkey limit 50")
def admin_browse(spark, sf_dir):
    """A privileged page with filters: fifty rows out of the first thousand."""
    q = orders_query(spark, sf_dir).where("eq", "o_orderstatus", "F").where("gt", "o_totalprice", 50000.0)
    return q.page_frame(50, max_scan=1000).select("o_orderkey")


@query("select event_id as ts, user_id as doc_id, event_type = 'error' as deleted from events where event_type <> 'error'")
def feed_deduplicated(spark, sf_dir):
    """A feed that gave every change twice, each once."""
    feed = doclog.changes(the_log(spark, sf_dir)).select("ts", "doc_id", "op", "change_id")
    return standing.once(feed.union(feed)).where("op <> 'delete'").select("ts", "doc_id", (F.col("op") == "delete").alias("deleted"))
