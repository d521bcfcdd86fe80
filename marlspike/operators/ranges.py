"""Read and write sets as interval tables, and what overlaps what.

An interval is (keyspace, low, high) over integer keys, half-open; a null `high` is unbounded. The join of points with
intervals is an equi-join on keyspace and grid cell. The grid has levels whose cells are 64 times as wide as those of
the level before; an interval is stored in the cells that it touches at the first level where these are 65 at most,
and a point looks up its own cell at every level. An interval without an upper bound ends at the keyspace's highest
point for this, so it has no more cells than others. No pair outside a common cell is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlspike.operators.prefix import BEFORE, UP_TO, ranges_of
from marlspike.session import materialize

#: 11 levels of 6 bits cover all 64 bits of a key.
LEVELS, STEP = 11, 6
#: Commits, or subscriptions, of a block: as many rows of a key as Spark's merge join holds as they are.
BLOCK = 4096
#: Pairs of classes that may be broadcast.
FEW_CLASSES = 100_000


def intersects(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return (b_high.isNull() | (a_low < b_high)) & (a_high.isNull() | (b_low < a_high))


def holds(key: Column, low: Column, high: Column) -> Column:
    return (key >= low) & (high.isNull() | (key < high))


def stored_cells(low: Column, last: Column) -> Column:
    """(level, cell) pairs of the keys from low to last: at the first level where the cells are 66 at most.

    Halves are compared, since a difference of two keys can overflow.
    """
    cell = lambda x, i: F.shiftright(x, STEP * i) if i else x
    pair = lambda i: lambda c: F.struct(F.lit(i).alias("l"), c.alias("c"))
    out = F.array().cast("array<struct<l:int,c:bigint>>")
    for i in range(LEVELS - 1, -1, -1):
        few = F.shiftright(last, STEP * i + 1) - F.shiftright(low, STEP * i + 1) <= 32
        out = F.when(few, F.transform(F.sequence(cell(low, i), cell(last, i)), pair(i))).otherwise(out)
    return out


def stab(points: DataFrame, intervals: DataFrame, key: str = "key") -> DataFrame:
    """Each point (keyspace, key, ...) with each interval of its keyspace that holds it."""
    tops = points.groupBy(F.col("keyspace").alias("_ks")).agg(F.max(F.col(key).cast("long")).alias("_top"))
    kept = intervals.join(tops, F.col("keyspace") == F.col("_ks")).where(F.col("low") <= F.col("_top"))
    kept = kept.where(F.col("high").isNull() | (F.col("low") < F.col("high")))
    last = F.least(F.coalesce(F.col("high").cast("long") - 1, "_top"), "_top")
    stored = kept.withColumn("_at", F.explode(stored_cells(F.col("low").cast("long"), last))).drop("keyspace", "_top")
    levels = sorted(r[0] for r in stored.select("_at.l").distinct().collect())  # 11 at most; points look at no other
    places = [F.struct(F.lit(i).alias("l"), (F.shiftright(F.col(key).cast("long"), STEP * i) if i else F.col(key).cast("long")).alias("c")) for i in levels or [0]]
    asked = points.withColumn("_p", F.explode(F.array(*places)))
    met = asked.join(stored, (asked["keyspace"] == stored["_ks"]) & (F.col("_p.l") == F.col("_at.l")) & (F.col("_p.c") == F.col("_at.c")))
    return met.where(holds(F.col(key), F.col("low"), F.col("high"))).drop("_p", "_at", "_ks")


def affected(subscriptions: DataFrame, writes: DataFrame) -> DataFrame:
    """Subscriptions that a commit's point writes invalidate: by range, or by table for those without ranges.

    `subscriptions` has sub_id, keyspace, low, high (null low: the whole keyspace); `writes` has commit_ts, keyspace, key.
    """
    ranged = stab(writes.select("commit_ts", "keyspace", "key"), subscriptions.where(F.col("low").isNotNull()))
    tables = writes.select("commit_ts", "keyspace").distinct()
    whole = tables.join(subscriptions.where(F.col("low").isNull()).select("sub_id", "keyspace"), "keyspace")
    return ranged.select("commit_ts", "sub_id").union(whole.select("commit_ts", "sub_id")).distinct()


def by_space(polls: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commit_ts, sub_id) of polls and subscriptions with a keyspace in common, each once; then the keyspaces of
    each commit (commit_ts, _rose) and of each subscription (sub_id, _watched).

    Commits, and subscriptions, with the same keyspaces are a class. Classes with a keyspace in common meet whole, in
    blocks two by two, so no pair is formed twice and the pairs need no shuffle, which is as large as they are.
    """
    told = lambda df, key, name: df.where("keyspace is not null").groupBy(key).agg(F.sort_array(F.collect_set("keyspace")).alias(name))
    rose = materialize(told(polls, "commit_ts", "_rose"), "rose")
    watched = materialize(told(subscriptions, "sub_id", "_watched"), "watched")
    blocks = lambda df, name, n: df.groupBy(name).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)).withColumn("keyspace", F.explode(name))
    classes = blocks(rose, "_rose", "_m").join(blocks(watched, "_watched", "_n"), "keyspace").drop("keyspace").distinct()
    classes = materialize(classes.withColumn("_class", F.monotonically_increasing_id()), "classes")
    classes = classes.hint("broadcast" if classes.count() <= FEW_CLASSES else "merge")
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rose.join(classes, "_rose").select("commit_ts", "_class", own("commit_ts", "_m").alias("_i"), every("_n").alias("_j"))
    right = watched.join(classes, "_watched").select("sub_id", "_class", own("sub_id", "_n").alias("_j"), every("_m").alias("_i"))
    return left.join(right, ["_class", "_i", "_j"]).select("commit_ts", "sub_id"), rose, watched


def affected_at(subscriptions: DataFrame, writes: DataFrame, polls: DataFrame) -> DataFrame:
    """`affected`, and the subscriptions of global tables whose version rose: `polls` has (commit_ts, keyspace)."""
    risen, rose, watched = by_space(polls, subscriptions)
    hit = affected(subscriptions, writes)
    met = hit.join(rose.withColumnRenamed("commit_ts", "_ts"), F.col("commit_ts").eqNullSafe(F.col("_ts")), "left")
    met = met.join(watched.withColumnRenamed("sub_id", "_id"), F.col("sub_id").eqNullSafe(F.col("_id")), "left")
    others = met.where(~F.coalesce(F.arrays_overlap("_rose", "_watched"), F.lit(False)))
    return others.select("commit_ts", "sub_id").union(risen)


def conflicts(transactions: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Optimistic validation as a report: transactions whose validated reads a later commit wrote into.

    `transactions` has txn_id, snapshot_ts, commit_ts; `reads` has txn_id, keyspace, low, high, validated.
    """
    checked = reads.where("validated").join(transactions, "txn_id")
    met = stab(writes.select(F.col("commit_ts").alias("write_ts"), "keyspace", "key"), checked)
    return met.where("write_ts > snapshot_ts and write_ts < commit_ts").groupBy("txn_id").agg(F.min("write_ts").alias("first_conflict"), F.countDistinct("write_ts").alias("n_conflicts"))


def over_limit(ops: DataFrame, most: int = 4096) -> DataFrame:
    """Transactions with more reads or writes than the limit."""
    return ops.groupBy("txn_id").agg(F.count_if(F.col("kind") == "read").alias("n_reads"), F.count_if(F.col("kind") == "write").alias("n_writes")).where((F.col("n_reads") > most) | (F.col("n_writes") > most))


def union_ranges(ranges: DataFrame) -> DataFrame:
    """A range set with overlapping and touching members merged, per keyspace.

    Ranges are dealt by keyspace and low end, and merged inside each part; what the parts before it reach and how many
    runs they have is carried over from one row per keyspace and part.
    """
    end = F.lit(2**63 - 1)
    order = [F.col("keyspace"), F.col("low"), F.col("_top")]
    dealt = ranges_of(ranges.withColumn("_top", F.coalesce("high", end)), order)
    parts = dealt.groupBy("keyspace", "_part").agg(F.max("_top").alias("_reach"))
    over_parts = Window.partitionBy("keyspace").orderBy("_part").rowsBetween(*BEFORE)
    carried = parts.select("keyspace", "_part", F.max("_reach").over(over_parts).alias("_reached"))
    inside = Window.partitionBy("keyspace", "_part").orderBy("low", "_top")
    met = dealt.join(carried, ["keyspace", "_part"])
    before = F.greatest(F.max("_top").over(inside.rowsBetween(*BEFORE)), "_reached")
    started = met.withColumn("_new", F.when(before.isNull() | (before < F.col("low")), 1).otherwise(0))
    counts = started.groupBy("keyspace", "_part").agg(F.sum("_new").alias("_runs"))
    counts = counts.select("keyspace", "_part", F.coalesce(F.sum("_runs").over(over_parts), F.lit(0)).alias("_earlier"))
    run = started.join(counts, ["keyspace", "_part"]).withColumn("_run", F.col("_earlier") + F.sum("_new").over(inside.rowsBetween(*UP_TO)))
    out = run.groupBy("keyspace", "_run").agg(F.min("low").alias("low"), F.max("_top").alias("_top"))
    return out.select("keyspace", "low", F.when(F.col("_top") < end, F.col("_top")).alias("high"))


def written_tables(ranges: DataFrame) -> DataFrame:
    """Distinct tables of a write set's keyspaces, `table:<t>` or `index:<t>:<name>`."""
    return ranges.select(F.element_at(F.split("keyspace", ":"), 2).alias("table_name")).distinct()
