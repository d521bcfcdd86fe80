"""Session helpers: building a session, reading tables, shared scratch space, shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Spark's switch that removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def get_spark(app: str = "marlspike", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MARLSPIKE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Only Spark's reader touches the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that every executor and the driver share.

    `spark.checkpoint.dir` of the session wins. Without it a local master gets a temporary folder that
    goes at exit; any other master gets a folder in the warehouse, never a machine-local one.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not getattr(sc, "_marlspike_scratch", None):
        own = tempfile.mkdtemp(prefix="marlspike-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc._marlspike_scratch = f"file://{own}"
        sc.setCheckpointDir(sc._marlspike_scratch)
    return sc._marlspike_scratch


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with some settings while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str = "step", records: int | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder: lost executors cost a re-read, not a recomputation.

    The shuffle files of the write go when it ends, since nothing reads them again. `records` is the size of the
    batches that go to Python, for rows with long texts.
    """
    path = scratch_path(df.sparkSession, tag)
    with settings(df.sparkSession, {CLEANUP: "true"} | ({RECORDS: str(records)} if records else {})):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._marlspike_path = path
    left_over(df.sparkSession).append(path)
    return out


def left_over(spark: SparkSession) -> list[str]:
    """Paths of the tables that `materialize` wrote and `discard` has not removed."""
    sc = spark.sparkContext
    if not hasattr(sc, "_marlspike_tables"):
        sc._marlspike_tables = []
    return sc._marlspike_tables


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Hadoop's file system layer, so any store will do."""
    jvm, conf, known = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), left_over(spark)
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in known:
            known.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote; nothing that reads them may run afterwards."""
    for df in tables:
        remove(df.sparkSession, [df._marlspike_path])


def ship(spark: SparkSession) -> None:
    """Give executors this package, so Python stages import it wherever the driver was started.

    Batches that go to Python get 1,024 rows where the session has Spark's default of 10,000: rows here hold whole texts.
    """
    sc = spark.sparkContext
    if spark.conf.get(RECORDS) == "10000":
        spark.conf.set(RECORDS, "1024")
    if getattr(sc, "_marlspike_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marlspike-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "marlspike_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(archive)
    sc._marlspike_shipped = True
