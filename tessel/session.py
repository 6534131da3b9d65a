"""Session building and shared-folder helpers."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark drops a query's shuffle files at its end if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that the innermost ``scratch`` of this thread has to delete; a thread sees no other thread's.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_lock, _writers, _before = threading.Lock(), 0, None


def build_session(app: str = "tessel", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSEL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config(CLEANUP, "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session gets one under /tmp; on a cluster executors don't share /tmp, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"/tmp/tessel-checkpoints-{os.getpid()}")
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on as long as any thread writes; after the last one it is as before."""
    global _writers, _before
    with _lock:
        if _writers == 0:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if _writers == 0:
                spark.conf.set(CLEANUP, _before) if _before else spark.conf.unset(CLEANUP)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def at_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives the planner a true size, so that it
    broadcasts the table only if that size allows it. As the files stand for the result, its shuffle files go at once.
    The folder goes with ``release``, with the ``scratch`` it was written in, or else when the driver ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with _cleanup(spark):
        df.write.parquet(path)
    keep_until_exit(spark, path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def keep_until_exit(spark: SparkSession, path: str) -> None:
    files, at = at_path(spark, path)
    files.deleteOnExit(at)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, at = at_path(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)


def release(*settled: DataFrame) -> None:
    """Delete the folders of settled tables that nothing reads any more: what was made of them is settled itself."""
    for df in settled:
        delete_folder(df.sparkSession, df.settled_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end what this thread settled within it, but for the tables put into the list it gives."""
    outer, own, keep = _scope.get(), [], []
    token = _scope.set(own)
    try:
        yield keep
    finally:
        _scope.reset(token)
        kept = {df.settled_at for df in keep}
        for path in own:
            if path not in kept:
                delete_folder(spark, path)
            elif outer is not None:
                outer.append(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it comes in fewer parts than there are, as small tables do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
