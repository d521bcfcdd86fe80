"""Registered queries over the driver's tables, and DuckDB SQL for each that SQL can express.

Each entry names an operator or a family of them. A query reads whole tables; a limit stands only where the operator
is a limit (take, page, top-k).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.functions import hashing
from marlspike.operators import incremental, jobs, ranges
from marlspike.plans.predicates import Relation, Schema, merge_policy, restrict
from marlspike.plans.query import encode_cursor, over
from marlspike.session import ship, table
from marlspike.sources import log as doclog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events_query(spark, sf_dir):
    return over(table(spark, sf_dir, "events"), ["user_id", "ts"], ["event_id"], "by_user_ts")


def orders_query(spark, sf_dir):
    return over(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], ["o_orderkey"], "by_customer_date")


def the_log(spark, sf_dir):
    return doclog.from_events(table(spark, sf_dir, "events"))


def shop(spark, sf_dir) -> Schema:
    t = lambda n: table(spark, sf_dir, n)
    return Schema(
        {n: t(n) for n in ("customer", "orders", "lineitem", "nation", "region")},
        {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "nation": "n_nationkey", "region": "r_regionkey"},
        {
            "customer": {"orders": Relation("orders", "o_custkey"), "nation": Relation("nation", "c_nationkey", False)},
            "orders": {"lines": Relation("lineitem", "l_orderkey"), "customer": Relation("customer", "o_custkey", False)},
            "nation": {"region": Relation("region", "n_regionkey", False)},
        },
    )


FROM, TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)

# Scans, predicates, order and pages


@query("select event_id, user_id, ts, event_type, value from events where user_id = 7 and ts >= timestamp '2024-01-10' and coalesce(value > 20, false) order by ts desc nulls last, event_id desc limit 5")
def scan_index_take(spark, sf_dir):
    q = events_query(spark, sf_dir).eq("user_id", 7).gte("ts", FROM).where("gt", "value", 20.0).order("desc")
    return q.take(5).select("event_id", "user_id", "ts", "event_type", "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_index_take(spark, sf_dir)


@query("select event_id, ts from events where user_id = 11 and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def scan_index_range(spark, sf_dir):
    return events_query(spark, sf_dir).eq("user_id", 11).gte("ts", FROM).lt("ts", TO).collect_frame().select("event_id", "ts")


@query("select count(*) as n, min(event_id) as low, max(event_id) as high from events")
def scan_table(spark, sf_dir):
    return over(table(spark, sf_dir, "events"), [], ["ts", "event_id"], "by_creation").matching().agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 1000")
def get_by_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey") == 1000).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("select event_id from events where user_id = 3")
def range_terms_ignored(spark, sf_dir):
    """The first equality on a field wins; a range on a field that is not next in the index does nothing."""
    return events_query(spark, sf_dir).eq("user_id", 3).eq("user_id", 4).gt("value", 99.0).gt("event_id", 10**9).matching().select("event_id")


@query("select o_orderkey from orders where o_custkey is null or o_custkey < 20")
def range_upper_bound_admits_null(spark, sf_dir):
    return orders_query(spark, sf_dir).lt("o_custkey", 20).matching().select("o_orderkey")


@query("""select event_id from events where (event_type in ('click','view') or not coalesce(value >= 10, false))
  and not (event_type = 'error') and user_id not in (1,2) and value is not null""")
def filter_algebra(spark, sf_dir):
    tree = {"OR": [{"event_type": {"in": ["click", "view"]}}, {"NOT": {"value": {"gte": 10.0}}}], "NOT": {"event_type": "error"}, "user_id": {"notIn": [1, 2]}, "value": {"isNull": False}}
    return restrict(Schema({"events": table(spark, sf_dir, "events")}, {"events": "event_id"}), "events", tree).select("event_id")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where coalesce(cast(json_extract(props, '$.k') as bigint) > 50, false)")
def filter_field_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where(F.coalesce(F.col("k") > 50, F.lit(False)))


@query("select 0 as n_denied, count(*) as n_all from events")
def filter_constant_policies(spark, sf_dir):
    s = Schema({"events": table(spark, sf_dir, "events")}, {"events": "event_id"})
    none, every = (restrict(s, "events", t).agg(F.count("*").alias("n")) for t in (False, True))
    return none.select(F.col("n").cast("int").alias("n_denied")).crossJoin(every.select(F.col("n").alias("n_all")))


@query("select o_orderkey, o_orderdate from orders where o_custkey = 37 order by o_orderdate desc nulls last, o_orderkey desc limit 3 offset 3")
def page_second(spark, sf_dir):
    q = orders_query(spark, sf_dir).eq("o_custkey", 37).order("desc")
    return q.page_frame(3, q.paginate(3).next_cursor or encode_cursor([None] * 3)).select("o_orderkey", "o_orderdate")


@query("""select o_orderkey from (select * from orders where o_custkey >= 100 order by o_custkey, o_orderdate, o_orderkey limit 200)
  where o_totalprice > 100000 order by o_custkey, o_orderdate, o_orderkey limit 20""")
def page_scan_limit(spark, sf_dir):
    return orders_query(spark, sf_dir).gte("o_custkey", 100).where("gt", "o_totalprice", 100000.0).page_frame(20, max_scan=200).select("o_orderkey")


@query("""with k as (select *, (row_number() over (order by o_orderdate, o_orderkey) - 1) // 10 as page from orders where o_custkey = 37)
  select page, min(o_orderkey) filter (o_rank = 1) as first_key, n from (select page, o_orderkey, row_number() over (partition by page order by o_orderdate, o_orderkey) as o_rank,
  count(*) over (partition by page) as n from k) group by page, n""")
def page_fences(spark, sf_dir):
    q = orders_query(spark, sf_dir).eq("o_custkey", 37)
    return q.page_bounds(10).select("page", F.col("first.o_orderkey").alias("first_key"), "n")


@query("""select c_custkey, c_name from customer where c_nationkey = 5 and c_mktsegment = 'BUILDING' and c_acctbal > 0""")
def policy_row_security(spark, sf_dir):
    tree = merge_policy({"c_mktsegment": "BUILDING", "c_acctbal": {"gt": 0.0}}, {"c_nationkey": 5})
    return restrict(shop(spark, sf_dir), "customer", tree).select("c_custkey", "c_name")


# Relations


@query("select c_custkey from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def relation_some(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "customer", {"orders": {"some": {"o_totalprice": {"gt": 300000.0}}}}).select("c_custkey")


@query("select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def relation_none(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "customer", {"orders": {"none": {"o_totalprice": {"gt": 300000.0}}}}).select("c_custkey")


@query("select o_orderkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey and not coalesce(l_quantity < 40, false))")
def relation_every(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "orders", {"lines": {"every": {"l_quantity": {"lt": 40.0}}}}).select("o_orderkey")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name = 'EUROPE')))")
def relation_is_nested(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "orders", {"customer": {"is": {"nation": {"is": {"region": {"is": {"r_name": "EUROPE"}}}}}}}).select("o_orderkey")


@query("select o_orderkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def relation_is_not(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "orders", {"customer": {"isNot": {"c_mktsegment": "BUILDING"}}}).select("o_orderkey")


@query("select c_custkey from customer c where c_acctbal > 9000 or not exists (select 1 from orders where o_custkey = c_custkey)")
def relation_in_or(spark, sf_dir):
    return restrict(shop(spark, sf_dir), "customer", {"OR": [{"c_acctbal": {"gt": 9000.0}}, {"orders": {"none": True}}]}).select("c_custkey")


# The document log

LATEST = "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events{where}) where rn = 1"


@query(f"select user_id as doc_id, event_id as ts, event_type, value from ({LATEST.format(where='')}) where event_type <> 'error'")
def log_as_of(spark, sf_dir):
    return doclog.as_of(the_log(spark, sf_dir)).select("doc_id", "ts", "value.event_type", "value.value")


@query(f"select user_id as doc_id, event_id as ts from ({LATEST.format(where=' where event_id <= 500')}) where event_type <> 'error'")
def log_as_of_past(spark, sf_dir):
    return doclog.as_of(the_log(spark, sf_dir), 500).select("doc_id", "ts")


@query("select event_id as ts, user_id as doc_id, event_type = 'error' as deleted from events where event_id >= 100 and event_id < 160 order by event_id limit 40")
def log_tail(spark, sf_dir):
    return doclog.tail(the_log(spark, sf_dir), 100, 160, limit=40).select("ts", "doc_id", F.col("value").isNull().alias("deleted"))


CDC = """select event_id as ts, user_id as doc_id, lag(event_id) over w as prev_ts,
  case when event_type = 'error' then 'delete' when lag(event_id) over w is null then 'insert' else 'update' end as op,
  case when event_type <> 'error' then value end as new_value, case when lag(event_type) over w <> 'error' then lag(value) over w end as old_value,
  'events:' || user_id || ':' || event_id as change_id from events window w as (partition by user_id order by event_id)"""


@query(CDC)
def log_changes(spark, sf_dir):
    return doclog.changes(the_log(spark, sf_dir)).select("ts", "doc_id", "prev_ts", "op", F.col("value.value").alias("new_value"), F.col("old_value.value").alias("old_value"), "change_id")


@query(f"select ts, op, change_id from ({CDC}) where ts > 200 and ts <= 300")
def log_read_batch(spark, sf_dir):
    return doclog.read_log(the_log(spark, sf_dir), 200, 100)[0].select("ts", "op", "change_id")


@query("""select q.doc_id, q.at, e.event_id as rev_ts, case when e.event_type <> 'error' then e.value end as value
  from (select o_custkey % 200 as doc_id, o_orderkey % 5000 as at, o_orderkey from orders) q asof join events e on q.doc_id = e.user_id and q.at >= e.event_id""")
def log_previous(spark, sf_dir):
    asks = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("doc_id"), (F.col("o_orderkey") % 5000).alias("at"))
    return doclog.previous(the_log(spark, sf_dir), asks).select("doc_id", "at", "rev_ts", F.col("value.value").alias("value"))


@query(f"select 'events' as table_id, count(*) as n_docs from ({LATEST.format(where='')}) where event_type <> 'error'")
def log_count(spark, sf_dir):
    return doclog.count_live(the_log(spark, sf_dir))


@query("select coalesce(max(event_id), 0) as max_ts from events")
def log_max_timestamp(spark, sf_dir):
    return doclog.max_timestamp(the_log(spark, sf_dir))


@query(f"select event_type as key, user_id as doc_id, event_id as rev_ts from ({LATEST.format(where=' where event_id <= 5000')}) where event_type <> 'error'")
def log_index_scan(spark, sf_dir):
    log = the_log(spark, sf_dir)
    return doclog.index_scan(doclog.index_log(log, F.col("value.event_type")), log, 5000).select("key", "doc_id", "rev_ts")


@query("""with c as (select event_id as ts, length(props) as size, sum(length(props)) over (order by event_id) as upto from events)
  select ts from c where upto <= 2000 or ts = (select min(ts) from c)""")
def log_byte_cut(spark, sf_dir):
    feed = table(spark, sf_dir, "events").select(F.col("event_id").alias("ts"), "props")
    return doclog.byte_cut(feed, 2000, F.length("props"), ["ts"]).select("ts")


@query("select r_regionkey as k from region where r_regionkey <= least(3, 2)")
def log_garbage(spark, sf_dir):
    segments = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("last_ts"))
    consumers = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 2).alias("position"))
    return doclog.collect_garbage(segments, consumers, 3).select("k")


# Read sets, write sets, conflicts

SUBS = "select c_custkey as sub_id, 'orders' as keyspace, c_custkey as low, c_custkey + 1 + (c_custkey % 40) * (c_custkey % 7) as high from customer"


def subscriptions(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("sub_id"), F.lit("orders").alias("keyspace"), c.alias("low"), (c + 1 + (c % 40) * (c % 7)).alias("high"))


@query(f"select sub_id, count(*) as n_hits, max(o_orderkey) as last_write from ({SUBS}) join orders on o_custkey >= low and o_custkey < high group by sub_id")
def range_overlap(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.lit("orders").alias("keyspace"), F.col("o_custkey").alias("key"), "o_orderkey")
    return ranges.stab(points, subscriptions(spark, sf_dir)).groupBy("sub_id").agg(F.count("*").alias("n_hits"), F.max("o_orderkey").alias("last_write"))


@query(f"select distinct o_orderkey as commit_ts, sub_id from ({SUBS}) join orders on o_custkey >= low and o_custkey < high")
def range_affected(spark, sf_dir):
    writes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_ts"), F.lit("orders").alias("keyspace"), F.col("o_custkey").alias("key"))
    return ranges.affected(subscriptions(spark, sf_dir), writes)


@query(f"""select s.sub_id as txn_id, min(o_orderkey) as first_conflict, count(distinct o_orderkey) as n_conflicts from ({SUBS}) s
  join orders on o_custkey >= low and o_custkey < high where o_orderkey > s.sub_id * 5 and o_orderkey < s.sub_id * 5 + 300 group by s.sub_id""")
def range_conflicts(spark, sf_dir):
    subs = subscriptions(spark, sf_dir)
    txns = subs.select(F.col("sub_id").alias("txn_id"), (F.col("sub_id") * 5).alias("snapshot_ts"), (F.col("sub_id") * 5 + 300).alias("commit_ts"))
    reads = subs.select(F.col("sub_id").alias("txn_id"), "keyspace", "low", "high", F.lit(True).alias("validated"))
    writes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_ts"), F.lit("orders").alias("keyspace"), F.col("o_custkey").alias("key"))
    return ranges.conflicts(txns, reads, writes)


# Standing queries


def snapshots(spark, sf_dir, t1=500, t2=None):
    log = the_log(spark, sf_dir)
    return tuple(doclog.as_of(log, t).select("doc_id", F.col("value").alias("row")) for t in (t1, t2))


@query(f"""with b as (select user_id, event_type, value, event_id from ({LATEST.format(where=' where event_id <= 500')}) where event_type <> 'error'),
  a as (select user_id, event_type, value, event_id from ({LATEST.format(where='')}) where event_type <> 'error')
  select coalesce(a.user_id, b.user_id) as doc_id, case when b.user_id is null then 'add' when a.user_id is null then 'remove' else 'edit' end as change, a.value
  from a full outer join b on a.user_id = b.user_id left join events ea on ea.event_id = a.event_id left join events eb on eb.event_id = b.event_id
  where (a.event_type, a.value, ea.props) is distinct from (b.event_type, b.value, eb.props) or a.user_id is null or b.user_id is null""")
def diff_snapshots(spark, sf_dir):
    return incremental.snapshot_diff(*snapshots(spark, sf_dir), "doc_id").select("doc_id", "change", "row.value")


@query(f"select user_id as doc_id, value from ({LATEST.format(where='')}) where event_type <> 'error' and value > 50")
def diff_apply_equals_recompute(spark, sf_dir):
    """A standing query (value over 50) kept by applying the feed's diffs to its past result."""
    log, admits = the_log(spark, sf_dir), lambda c: F.col(f"{c}.value") > 50
    base = doclog.as_of(log, 500).where(admits("value")).select("doc_id", F.col("value").alias("row"))
    changes = incremental.membership_diff(doclog.changes(log).where("ts > 500"), admits)
    return incremental.apply_changes(base, changes).select("doc_id", "row.value")


BYTES = "list_transform(string_split({}, ''), lambda x: ascii(x))"


@query(f"""with r as (select list_concat({BYTES.format('cast(user_id as varchar)')}, [0], {BYTES.format('cast(event_id as varchar)')}, [0], {BYTES.format('event_type')}) as b
    from ({LATEST.format(where='')}) where event_type <> 'error'),
  h as (select list_reduce(list_transform(list_prepend(2166136261, b), lambda x: cast(x as hugeint)), lambda a, x: (xor(a, x) * 16777619) % 4294967296) as v from r)
  select lpad(lower(printf('%x', cast(bit_xor(cast(v as bigint)) as bigint))), 8, '0') as checksum from h""")
def diff_checksum(spark, sf_dir):
    ship(spark)
    rows = doclog.as_of(the_log(spark, sf_dir))
    return incremental.checksum(rows, F.col("doc_id"), F.col("ts"), F.col("value.event_type"))


@query("select event_type as table_name, event_id as poll, n as version from (select event_type, event_id, user_id % 5 as n, lag(user_id % 5) over (partition by event_type order by event_id) as p from events) where p is not null and n > p")
def poll_versions(spark, sf_dir):
    polls = table(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), F.col("event_id").alias("poll"), (F.col("user_id") % 5).alias("version"))
    return incremental.version_poll(polls)


@query("""with b as (select r_regionkey as k, r_name as v from region), s as (select n_nationkey % 7 as k, max(n_name) as v from nation group by 1)
  select * from s where k % 2 = 0 union all select * from b where k not in (select k from s)""")
def overlay_own_writes(spark, sf_dir):
    base = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    staged = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 7).alias("k")).agg(F.max("n_name").alias("v"))
    return incremental.overlay(base, staged.withColumn("op", F.when(F.col("k") % 2 == 0, "put").otherwise("delete")), "k")


# Jobs, notifications, receipts, authorization

JOBS = "select event_id as job_id, case event_type when 'view' then 'pending' when 'click' then 'inProgress' else 'success' end as state, value as next_ts, user_id from events"


def the_jobs(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "inProgress").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), state.alias("state"), F.col("value").alias("next_ts"), (F.col("event_id") % 4).alias("attempts"), F.lit(3).alias("max_failures"), (F.col("value") + 5).alias("lease_expires"), F.when(F.col("event_id") % 10 > 0, F.floor(F.col("event_id") / 10)).alias("parent_id"))


@query(f"select job_id, next_ts from ({JOBS}) where state = 'pending' and next_ts <= 20 order by next_ts, job_id limit 64")
def jobs_due(spark, sf_dir):
    return jobs.due(the_jobs(spark, sf_dir), 20.0).select("job_id", "next_ts")


@query(f"select min(next_ts) as next_ts from ({JOBS}) where state = 'pending' and next_ts > 20")
def jobs_next_due(spark, sf_dir):
    return jobs.next_due(the_jobs(spark, sf_dir), 20.0)


@query(f"""with d as (select job_id from ({JOBS}) where state = 'pending' and next_ts <= 20 order by next_ts, job_id limit 64)
  select case when job_id in (select job_id from d) then 'inProgress' else state end as state, count(*) as n from ({JOBS}) group by 1""")
def jobs_claim(spark, sf_dir):
    return jobs.claim(the_jobs(spark, sf_dir), 20.0).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""select job_id, case when state <> 'inProgress' then state when job_id % 4 + 1 >= 3 then 'failed' else 'pending' end as state,
  case when state = 'inProgress' and job_id % 4 + 1 < 3 then 1000.0 + floor(250 * pow(2.0, (job_id % 4 + 1) + 1) + 0.5) else next_ts end as next_ts from ({JOBS})""")
def jobs_fail(spark, sf_dir):
    j = the_jobs(spark, sf_dir)
    return jobs.fail(j, j.where("state = 'inProgress'").select("job_id"), 1000.0).select("job_id", "state", "next_ts")


@query("""with recursive d as (select cast(3 as bigint) as job_id union select e.event_id from events e join d on e.event_id % 10 > 0 and e.event_id // 10 = d.job_id) select job_id from d""")
def jobs_descendants(spark, sf_dir):
    return jobs.descendants(spark, the_jobs(spark, sf_dir), 3)


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_wins(spark, sf_dir):
    return jobs.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("select user_id, count(*) filter (event_type <> 'view') as n_unread from events group by 1")
def notify_unread(spark, sf_dir):
    return jobs.unread(table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "view").alias("read")))


@query("select user_id as recipient, event_type as category, min(event_id) as oldest, count(*) as n_items, min(event_id) as first_item from events where value < 30 group by 1, 2 having 9000 - min(event_id) >= 500")
def notify_digests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("user_id").alias("recipient"), F.col("event_type").alias("category"), F.col("event_id").alias("created_at"), F.col("event_id").alias("item_id"), F.when(F.col("value") < 30, F.lit(None)).otherwise(1).alias("flushed_at"))
    return jobs.digests_due(items, 9000, 500).select("recipient", "category", "oldest", F.size("items").cast("long").alias("n_items"), F.element_at("items", 1)["item_id"].alias("first_item"))


STATUS = "case event_type when 'view' then 'dropped' when 'click' then 'bounced' when 'signup' then 'complained' when 'purchase' then 'delivered' else 'opened' end"


@query(f"""with s as (select user_id, event_id, {STATUS} as status, case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 2 when 'purchase' then 3 else 4 end as r from events)
  select user_id as message_id, arg_max(status, (r, -event_id)) as status, min(event_id) filter (status = 'complained') as complained_at from s group by 1""")
def notify_status(spark, sf_dir):
    status = F.expr(STATUS)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), status.alias("status"), F.col("event_id").alias("ts"), F.lit(0).alias("seq"))
    return jobs.settle_status(e)


@query("""select c.client_id, c.seq, coalesce(r.verdict, case when c.seq <= c.client_id * 40 then 'stale' else 'unknown' end) as status
  from (select user_id as client_id, event_id as seq from events) c left join (select user_id as client_id, event_id as seq, case when event_type = 'error' then 'failed' else 'applied' end as verdict from events where event_id % 3 = 0) r using (client_id, seq)""")
def receipts_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("u").alias("identity"), F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("applied").alias("verdict"))
    floors = e.select("identity", "client_id").distinct().withColumn("floor", F.col("client_id") * 40)
    return jobs.classify_receipts(e.drop("verdict"), e.where("seq % 3 = 0"), floors).select("client_id", "seq", "status")


@query("select user_id as client_id, greatest(user_id * 10, coalesce(max(event_id) filter (event_id < 4000), 0)) as floor from events group by 1")
def receipts_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("u").alias("identity"), F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("created_at"))
    floors = e.select("identity", "client_id").distinct().withColumn("floor", F.col("client_id") * 10)
    return jobs.sweep_receipts(e, floors, 5000, 1000)[1].select("client_id", "floor")


@query("select client_id, seq, (row_number() over (partition by client_id order by seq) - 1) // 50 as chunk from (select user_id as client_id, event_id as seq from (select *, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id) as stop from events) where stop = 0)")
def outbox_drain(spark, sf_dir):
    out = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "transient").otherwise("ok").alias("outcome"))
    return jobs.drain(out).select("client_id", "seq", "chunk")


@query("""select n_nationkey as user_id, n_regionkey as scope_id, max(case when p.pattern in ('orders:read', 'orders:*', '*:read', '*:*') then 1 else 0 end) = 1 as granted
  from nation left join (select r_regionkey as k, case when r_regionkey % 2 = 0 then 'orders:*' else 'parts:read' end as pattern from region) p on p.k = n_regionkey group by 1, 2""")
def authz_can(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.lit("region").alias("scope_type"), F.col("n_regionkey").cast("string").alias("scope_id"))
    grants = n.withColumn("permission", F.when(F.col("scope_id").cast("int") % 2 == 0, "orders:*").otherwise("parts:read"))
    return jobs.can(n.withColumn("permission", F.lit("orders:read")), grants).select("user_id", F.col("scope_id").cast("int").alias("scope_id"), "granted")


@query("""select 'insert' as action, n_nationkey as k from nation where n_regionkey = 1 and n_nationkey % 2 = 1 union all select 'delete', n_nationkey from nation where n_nationkey % 2 = 0 and n_regionkey <> 1""")
def authz_reconcile(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return jobs.reconcile(n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k")), n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


# Hashes and partitions


@query()
def shard_of_key(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.shard_of(F.col("c_custkey"), 8).alias("shard"))


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def extension_group_by(spark, sf_dir):
    """An extension, not an operator of the reference: plain aggregation over a pushed-down filter."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= dt.datetime(1998, 9, 2))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


from marlspike.queries import extra, more  # noqa: E402,F401  (register more queries here)
