"""Storing an intermediate result that several branches of a plan read."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders that this process wrote, until `clean` removes them.
_written: list[str] = []
# Open scopes of each thread, the innermost last.
_open: dict[int, list[list[str]]] = {}
# Spark's setting for removing the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, named in ``spark.checkpoint.dir``.

    Without the setting, a local master gets a folder of its own; a cluster has none that is safe
    to take, so this raises at once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="fitloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """Name of a new folder inside the shared one."""
    path = f"{shared_folder(spark).rstrip('/')}/fitloom-{uuid.uuid4().hex}"
    scopes = _open.get(threading.get_ident())
    if scopes:
        scopes[-1].append(path)
        return path
    if not _written:
        atexit.register(clean, spark)
    _written.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread cuts inside are removed at the end; frames that read them are then gone."""
    scopes = _open.setdefault(threading.get_ident(), [])
    scopes.append([])
    try:
        yield
    finally:
        _remove(spark, scopes.pop())


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, not when the driver happens to collect its
    garbage. For writes: what is stored needs no shuffle any more, and a write is planned anew each time."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    This runs a job while the plan is being built. The stored table survives lost executors, keeps
    later branches from repeating the work, is read by column, and has a known size that the
    optimizer can base a broadcast on. It stays until the
    `scope` around it ends, else until `clean`, at the latest until Python ends.
    """
    path = scratch(df.sparkSession)
    with no_shuffles_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        try:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def clean(spark: SparkSession) -> None:
    """Remove every table that `cut` wrote outside of a `scope`; frames that read them can't be used any more."""
    _remove(spark, _written)
