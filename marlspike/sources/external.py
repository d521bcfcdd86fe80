"""Tables and files of other stores: relational databases over JDBC, and raw files with byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marlspike.sources.tables import from_row, to_row


def read_jdbc(spark: SparkSession, url: str, table: str, schema: StructType, split: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """Documents of a relational table. Filters and columns that the plan asks for reach the database.

    `split` is (numeric column, lowest, highest, partitions): the table is then read in parallel.
    """
    options = {} if split is None else dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), split))
    return from_row(spark.read.jdbc(url, table, properties=properties, **options), schema)


def write_jdbc(docs: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    """Documents as rows of a relational table, in batches from each partition."""
    to_row(docs).write.jdbc(url, table, mode, properties)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and modificationTime of files; contents are not read. Empty files are left out, as Spark has no rows for them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "modificationTime")


def byte_ranges(spark: SparkSession, path: str, asks: DataFrame) -> DataFrame:
    """(name, low, high, bytes) for asks of bytes low <= i < high of files by name; a range past the end is cut. Files that are not there, or empty, have no row."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    part = F.expr("substring(content, cast(low + 1 as int), cast(greatest(least(high, length(content)) - low, 0) as int))")
    return asks.join(found, "name").select("name", "low", "high", part.alias("bytes"))
