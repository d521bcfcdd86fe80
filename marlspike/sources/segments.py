"""The log in an object store: segments of commits, snapshots that cover them, and a manifest that names both.

A segment holds the revisions of a range of commit times (from 0) as JSON lines. The manifest is a small JSON text: the
newest snapshot and the segments after it. Defined cases: an empty range writes no segment, yet the manifest's end moves
on; a shard without segments contributes nothing to a merge.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marlspike.session import remove
from marlspike.sources.log import KEY, latest

EMPTY = {"snapshot": None, "covers": -1, "end": -1, "segments": []}


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest; versions are numbered, and the highest wins."""
    try:
        rows = spark.read.format("binaryFile").load(f"{root}/manifest/*").select(F.regexp_extract("path", r"m-(\d+)\.json", 1).cast("long").alias("n"), "content")
        top = rows.orderBy(F.col("n").desc()).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        top = None
    return dict(EMPTY, version=0) if top is None else json.loads(bytes(top["content"]).decode())


def swap(spark: SparkSession, root: str, old: dict, new: dict) -> dict:
    """Write the manifest after `old`; raises if another writer has done so, since the file is made only if absent."""
    new = {**new, "version": old["version"] + 1}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/m-{new['version']}.json")
    out = path.getFileSystem(conf).create(path, False)
    try:
        out.write(bytearray(json.dumps(new).encode()))
    finally:
        out.close()
    return new


def append(log: DataFrame, root: str, upto: int) -> dict:
    """Write the revisions after the manifest's end, up to `upto`, as a segment."""
    spark = log.sparkSession
    old = manifest(spark, root)
    part = log.where((F.col("ts") > old["end"]) & (F.col("ts") <= upto))
    name, segments = f"segment-{uuid.uuid4().hex}", old["segments"]
    if not part.isEmpty():
        part.write.option("ignoreNullFields", "false").json(f"{root}/{name}")
        segments = [*segments, {"name": name, "low": old["end"], "high": upto}]
    return swap(spark, root, old, {**old, "end": max(upto, old["end"]), "segments": segments})


def read(spark: SparkSession, root: str, schema: StructType, after: int = -1, upto: int | None = None) -> DataFrame:
    """Revisions after `after` up to `upto` from the snapshot and the segments that reach into that range."""
    m = manifest(spark, root)
    names = [s["name"] for s in m["segments"] if s["high"] > after and (upto is None or s["low"] < upto)]
    if m["snapshot"] and m["covers"] > after:
        names.append(m["snapshot"])
    found = spark.read.schema(schema).json([f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    found = found.where(F.col("ts") > after)
    return found if upto is None else found.where(F.col("ts") <= upto)


def snapshot(spark: SparkSession, root: str, schema: StructType) -> dict:
    """Compact everything up to the manifest's end into one snapshot of newest revisions, tombstones included."""
    old = manifest(spark, root)
    name = f"snapshot-{uuid.uuid4().hex}"
    latest(read(spark, root, schema)).select(*schema.names).write.option("ignoreNullFields", "false").json(f"{root}/{name}")
    return swap(spark, root, old, {**old, "snapshot": name, "covers": old["end"], "segments": []})


def sweep(spark: SparkSession, root: str, old: dict) -> list[str]:
    """Delete what an older manifest named and the newest one does not; the names that went."""
    now = manifest(spark, root)
    kept = {now["snapshot"], *[s["name"] for s in now["segments"]]}
    gone = [n for n in (old["snapshot"], *[s["name"] for s in old["segments"]]) if n and n not in kept]
    remove(spark, [f"{root}/{n}" for n in gone])
    return gone


def tail(replica: DataFrame, root: str, schema: StructType, mark: int) -> tuple[DataFrame, int]:
    """(the replica with the revisions after `mark` applied as they are, the new mark). An empty range moves the mark too."""
    spark = replica.sparkSession
    end = manifest(spark, root)["end"]
    fresh = read(spark, root, schema, mark, end)
    key = [*KEY, "ts"]
    return replica.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*replica.columns)), max(end, mark)


def merged(shards: list[DataFrame], order: list[str], limit: int | None = None) -> DataFrame:
    """Sorted streams of shards as one, at most `limit` rows: each shard gives its first ones before they meet."""
    parts = shards if limit is None else [s.orderBy(*order).limit(limit) for s in shards]
    every = reduce(DataFrame.unionByName, parts).orderBy(*order)
    return every if limit is None else every.limit(limit)
