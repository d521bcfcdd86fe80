"""Writes to documents, as batches of operations that become revisions of the log.

An operation is (doc_id, op, value): insert, replace or delete. A batch is judged against the newest revisions before
it; what passes is appended at one commit time. Documents carry `_creationTime`, which a replacement keeps.

Defined cases: of several operations on one document in a batch the last by `seq` counts; a delete of a missing document
is accepted and writes nothing; null values are invalid for insert and replace; an empty batch writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marlspike.sources.log import KEY, latest

#: Why an operation is refused, in the order of the checks.
REASONS = ("exists", "missing", "invalid", "forbidden", "duplicate")


def judge(
    log: DataFrame,
    ops: DataFrame,
    valid: Callable[[str], Column] | None = None,
    policy: Callable[[str], Column] | None = None,
    unique: list[str] = (),
) -> DataFrame:
    """Each counted operation with its document's old value and `refused`: one of REASONS, or null.

    `ops` has columns table_id, doc_id, op, value (a struct) and seq. `valid` and `policy` make conditions from the name
    of a struct column; the policy has to hold for the old value and for the new one. No two live documents may agree
    in all `unique` fields; of new ones that do the lowest identifier wins.
    """
    holds = lambda make, c: F.lit(True) if make is None else F.coalesce(make(c), F.lit(False))
    last = ops.groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), "seq").alias("o")).select(*KEY, "o.*")
    now = latest(log).select(*KEY, F.col("ts").alias("old_ts"), F.col("value").alias("old_value"))
    met = last.join(now, KEY, "left")
    there, writes = F.col("old_value").isNotNull(), F.col("op").isin("insert", "replace")
    refused = F.when((F.col("op") == "insert") & there, "exists").when((F.col("op") == "replace") & ~there, "missing")
    refused = refused.when(writes & (F.col("value").isNull() | ~holds(valid, "value")), "invalid")
    refused = refused.when((there & ~holds(policy, "old_value")) | (writes & ~holds(policy, "value")), "forbidden")
    judged = met.withColumn("refused", refused)
    if not unique:
        return judged
    names = [f"_u{i}" for i in range(len(unique))]
    fields = lambda c: [F.col(f"{c}.{u}").alias(n) for u, n in zip(unique, names)]
    fresh = judged.where(writes & F.col("refused").isNull()).select(*KEY, *fields("value"))
    gone = judged.where(F.col("refused").isNull()).select(*KEY)
    stays = now.where(F.col("old_value").isNotNull()).join(gone, KEY, "left_anti").select("table_id", *fields("old_value"), F.lit(None).cast(fresh.schema["doc_id"].dataType).alias("doc_id"))
    # Of the documents that agree, one that stays (it sorts first) or the lowest new one holds the fields.
    every = fresh.select("table_id", *names, "doc_id").unionByName(stays)
    holder = every.groupBy("table_id", *names).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("fresh"), "doc_id")).alias("h")).select(F.col("table_id").alias("_t"), *[F.col(n).alias(f"{n}h") for n in names], "h")
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}h")) for n in names], F.col("table_id") == F.col("_t"))
    clash = fresh.join(holder, same).where(~F.col("h.fresh") | (F.col("doc_id") != F.col("h.doc_id"))).select(*KEY, F.lit("duplicate").alias("_clash"))
    return judged.join(clash, KEY, "left").withColumn("refused", F.coalesce("refused", "_clash")).drop("_clash")


def revisions(judged: DataFrame, ts: int, created: str = "created") -> DataFrame:
    """The revisions (table_id, doc_id, ts, value) that accepted operations write at commit time `ts`.

    A value's field `created` is set by the store: the commit time for an insert, the old one for a replacement.
    """
    kind = judged.schema["value"].dataType
    at = F.when(F.col("op") == "insert", F.lit(ts)).otherwise(F.col(f"old_value.{created}")).cast(kind[created].dataType)
    value = F.struct(*[at.alias(f.name) if f.name == created else F.col(f"value.{f.name}").alias(f.name) for f in kind])
    kept = judged.where(F.col("refused").isNull() & ((F.col("op") != "delete") | F.col("old_value").isNotNull()))
    return kept.select(*KEY, F.lit(ts).cast("long").alias("ts"), F.when(F.col("op") != "delete", value).alias("value"))


def compacted(value: Column) -> Column:
    """A document as JSON without its null fields: absent and undefined are the same."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def table_name(name: Column) -> Column:
    """(namespace, table) of a full table name; the root namespace is empty."""
    parted = F.split(name, "/", 2)
    return F.when(F.contains(name, F.lit("/")), F.struct(parted[0].alias("namespace"), parted[1].alias("table"))).otherwise(F.struct(F.lit("").alias("namespace"), name.alias("table")))


def strangers(numbers: DataFrame, target: DataFrame) -> DataFrame:
    """Tables of a dump (table_name, number) whose number the target has given to another table, or the other way round."""
    t = target.select(F.col("table_name").alias("_name"), F.col("number").alias("_number"))
    # Two joins on equality; with "or" between them Spark would look at every pair of tables.
    renumbered = numbers.join(t, (F.col("table_name") == F.col("_name")) & (F.col("number") != F.col("_number")), "left_semi")
    renamed = numbers.join(t, (F.col("number") == F.col("_number")) & (F.col("table_name") != F.col("_name")), "left_semi")
    return renumbered.union(renamed).select("table_name", "number").distinct()


def apply_dump(log: DataFrame, docs: DataFrame, numbers: DataFrame, target: DataFrame) -> DataFrame:
    """The log with a dump's revisions laid over it; raises if its table numbers clash with the target's."""
    if not strangers(numbers, target).isEmpty():
        raise ValueError("the dump's table numbers belong to other tables here")
    key = [*KEY, "ts"]
    return log.join(docs.select(*key), key, "left_anti").unionByName(docs.select(*log.columns))
