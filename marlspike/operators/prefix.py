"""Running totals over a whole ordered table, without a window that one task would hold.

The table is dealt into ranges of the order and written, so a row's range is settled; sums run inside each range, and
only one total per range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlspike.session import materialize

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def ranges_of(df: DataFrame, order: list[Column], part: str = "_part") -> DataFrame:
    """`df` as a written table with the number of the range of `order` that each row is in."""
    return materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows up to this one in `order`. An empty table stays empty."""
    dealt = ranges_of(df.withColumn("_value", value), order)
    totals = dealt.groupBy("_part").agg(F.sum("_value").alias("_total"))
    carried = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_carried"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*UP_TO))
    return dealt.join(carried, "_part").withColumn(name, inside + F.col("_carried")).drop("_part", "_value", "_carried")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with each row's place in `order`, from 1."""
    return running(df, order, F.lit(1).cast("long"), name)
