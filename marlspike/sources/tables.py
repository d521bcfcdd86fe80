"""Global tables: relational tables whose versions say which of them a batch touched, and the codec of their rows.

Defined cases: of several operations of a batch on one row the last by `seq` counts; a replacement or deletion of a row
that is not there does nothing; null cells are absent fields; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def by_index(rows: DataFrame, eq: dict, limit: int | None = None) -> DataFrame:
    """Rows whose fields equal the given values, a null one those without the field; no order, at most `limit`."""
    for name, value in eq.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows if limit is None else rows.limit(limit)


def commit_batch(rows: DataFrame, ops: DataFrame, key: str = "_id") -> DataFrame:
    """The table after a batch. `ops` has the table's columns, `op` (insert, replace, delete) and `seq`."""
    names = rows.columns
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", *[c for c in names if c != key]), "seq").alias("o")).select(key, "o.*")
    fresh = last.where("op = 'insert'").select(*names).unionByName(last.where("op = 'replace'").join(rows.select(key), key, "left_semi").select(*names))
    return rows.join(last.select(key), key, "left_anti").unionByName(fresh)


def bump_versions(versions: DataFrame, ops: DataFrame) -> DataFrame:
    """(table_name, version) after batches of writes (table_name, batch): one up for each batch that touched the table."""
    touched = ops.groupBy("table_name").agg(F.countDistinct("batch").alias("_n"))
    met = versions.join(touched, "table_name", "full_outer")
    return met.select("table_name", (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("version"))


def overlay_query(rows: DataFrame, staged: DataFrame, eq: dict, limit: int | None = None, key: str = "_id") -> DataFrame:
    """`by_index` over a table with staged writes: those that match come first, so a limit cannot drop them.

    `staged` has the table's columns and `op`, one row for each key.
    """
    own = by_index(staged.where("op <> 'delete'").select(*rows.columns), eq).withColumn("_first", F.lit(0))
    rest = by_index(rows.join(staged.select(key), key, "left_anti"), eq).withColumn("_first", F.lit(1))
    met = own.unionByName(rest)
    return met.drop("_first") if limit is None else met.orderBy("_first").limit(limit).drop("_first")


def to_row(docs: DataFrame) -> DataFrame:
    """Documents as cells of the relational store: Booleans as 0 and 1, integers as text, nested values as JSON."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int")
        if isinstance(f.dataType, T.LongType):
            return c.cast("string")
        return F.to_json(c) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else c

    return docs.select(*[cell(f).alias(f.name) for f in docs.schema])


def from_row(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """`to_row` undone."""

    def field(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return c == 1
        return F.from_json(c, f.dataType) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else c.cast(f.dataType)

    return rows.select(*[field(f).alias(f.name) for f in schema])


def put_globals(known: DataFrame, writes: DataFrame, if_absent: bool = False) -> DataFrame:
    """The key-value table after writes (key, value, seq), with `inserted`: whether a key is new.

    The last write of a key wins; with `if_absent` the first one does, and only where the key is not there.
    """
    pick = F.min_by if if_absent else F.max_by
    fresh = writes.groupBy("key").agg(pick("value", "seq").alias("_new")).withColumn("_w", F.lit(True))
    met = known.join(fresh, "key", "full_outer").withColumn("_k", F.col("value").isNotNull())
    value = F.coalesce("value", "_new") if if_absent else F.when(F.col("_w"), F.col("_new")).otherwise(F.col("value"))
    return met.select("key", value.alias("value"), (~F.col("_k") & F.coalesce("_w", F.lit(False))).alias("inserted"))
