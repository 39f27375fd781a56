"""Session settings the jobs expect."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# UTC keeps timestamps comparable across engines; AQE coalesces and splits skewed
# partitions at run time; a broadcast happens only below the byte threshold, so
# no side is broadcast on a guess.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder the cluster names; `fallback` only when none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or fallback


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one only in local mode."""
    root = checkpoint_dir(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", *, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; `by` names a column whose ranges become files.

    Used where one result feeds several branches: the branches share the stored
    rows, the plan stays small, and a lost executor costs a re-read. With `by` a
    filter on the column skips files by their statistics. `stored_tables` removes
    what was written inside it, `held` stores for a block only.
    """
    return _store(df, scratch(df.sparkSession, name), by)


def _store(df: DataFrame, path: str, by: str | None = None, *, rows: int = 0) -> DataFrame:
    spark = df.sparkSession
    if by:
        # stored as it comes first: ranges are sampled from it, and it needs no shuffle files any more while it is dealt out
        with held(df, "unsorted") as (unsorted, _):
            return _store(unsorted.repartitionByRange(by).sortWithinPartitions(by), path, rows=rows)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    for paths in _OPEN:
        paths.append(path)
    table = spark.read.parquet(path)  # a job of its own: the scheduler lets go of the one before
    release_shuffles(spark)
    return table


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended queries removed.

    Spark removes them once the driver collects its garbage, which a driver with memory to spare does seldom, while
    the disks of the executors fill. Files that a plan or a result at hand still refers to stay. Events of a query
    that wait for their listeners refer to it too, so these come first.
    """
    sc = spark.sparkContext
    with suppress(Py4JJavaError):  # a busy driver may take longer; then its files go the next time
        sc._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    sc._jvm.System.gc()


@contextmanager
def held(df: DataFrame, name: str = "held", *, by: str | None = None, rows: int = 0) -> Iterator[tuple[DataFrame, str]]:
    """`cut` for the length of a block: the table and its folder, removed when the block ends. `rows` bounds a file's rows (0: no bound)."""
    path = scratch(df.sparkSession, name)
    try:
        yield _store(df, path, by, rows=rows), path
    finally:
        remove(df.sparkSession, path)


_OPEN: list[list[str]] = []


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `cut` stored inside the block when it ends: finish reading the results before.

    The shared folder outlives the session, so a job that runs again and again should have an owner for them.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
